import pytest

from auditloom.functions import manifests, requirements


@pytest.mark.parametrize("text", ["example", "example>=1,<2", "example[foo,bar]~=1.0", "example (>=1.0)", "example; python_version < '3.13'", "example; os_name == 'posix' or sys_platform == 'linux'", "example @ https://example.com/example.whl",
                                  "a.b_c-d == 1.*", "a ; (python_version >= '3' and os_name != 'nt') or extra in 'x y'", "a; 'x' not in platform_machine", "a[b] @ file:///x ; extra == 'y'", "a===1.0+local", "A"])
def test_requirements(text):
    requirements.requirement(text)


@pytest.mark.parametrize("text", ["", "-a", "a b", "a[", "a[]", "a[b", "a ==", "a >= 1 < 2", "a (>=1", "a @", "a @ x y", "a;", "a; python_version", "a; python_version < 3", "a; wrong == 'x'", "a; os_name == 'x' and", "a; (os_name == 'x'", "a; os_name == 'x')", "a; __import__('os')", "a; os_name ~= 'x'", "a$b", "a='1'", "a; os_name is 'x'"])
def test_malformed_requirements(text):
    with pytest.raises(requirements.Malformed):
        requirements.requirement(text)


@pytest.mark.parametrize("text, want", [
    ("-r requirements.txt", ("requirements.txt", False)), ("--requirement=a/b.txt", ("a/b.txt", False)), ("-c ./c.txt", ("./c.txt", False)), ("-e ./libs/kit", ("./libs/kit", True)), ("-e .[x,y]", (".", True)), ("--editable lib", ("lib", True)),
    ("-e git+https://h/x.git#egg=x", None), ("--extra-index-url https://h/whl", None), ("--index-url=https://h", None), ("--pre", None), ("torch==2.4.1+cu121  # pinned", None), ("git+https://h/d.git@v0.0.93#egg=d", None), ("n==1 --hash=sha256:" + "a" * 64 + " \\", None), ("# only", None), ("   ", None), ("x#y @ https://h", "error"), ("--hash=sha256:a", "error"),
    ("-r ../outside.txt", "error"), ("-r /etc/passwd", "error"), ("-e ../escape", "error"), ("--unknown-option x", "error"), ("--index-url", "error"), ("--pre now", "error"), ("numpy --hash=md5:abc", "error"), ("--index-url a b", "error"), ("-r", "error"), ("-e", "error"), ("-", "error"), ("--", "error"),
])
def test_lines(text, want):
    if want == "error":
        with pytest.raises(requirements.Malformed):
            requirements.line(text)
    else:
        assert requirements.line(text) == want


@pytest.mark.parametrize("data, want", [
    (b"# -*- coding: latin-1 -*-\nx = '\xf1'", "# -*- coding: latin-1 -*-\nx = 'ñ'"), (b"\xef\xbb\xbfx = 1", "x = 1"), (b"#!/bin/py\n# vim: set fileencoding=cp1252 :\n'\x80'", "#!/bin/py\n# vim: set fileencoding=cp1252 :\n'€'"),
    (b"\n\n# coding: latin-1\n'\xc3\xb1'", "\n\n# coding: latin-1\n'ñ'"), (b"x = 1\n# coding: latin-1\n'\xc3\xb1'", "x = 1\n# coding: latin-1\n'ñ'"), (b"\xf1", None), (b"# coding: no-such\n", None), (b"", ""), (b"a\r\nb", "a\r\nb"),
])
def test_python_encodings(data, want):
    if want is None:
        with pytest.raises((ValueError, LookupError)):
            manifests.decode("a.py", data)
    else:
        assert manifests.decode("a.py", data) == want
    if data.startswith(b"\xef\xbb\xbf"):
        assert manifests.decode("a.toml", data) == "x = 1"
