"""A corpus of small sources for queries on code: document n becomes template n mod size.

The templates are written for this purpose; their expected findings are labelled by
hand from the rules' meaning, among them files that must give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt

#: (file name, content, [(rule id, first line)])
TEMPLATES: list[tuple[str, str, list[tuple[str, int]]]] = [
    ("shell_agent.py", "import os\nimport openai\n\n\ndef act(question):\n    answer = openai.chat.completions.create(model='m', messages=[question])\n    command = answer.choices[0].message.content\n    os.system(command)\n", [("EUAIA-ART12-001", 6), ("EUAIA-ART14-002", 8)]),
    ("logged_agent.py", "import logging\nimport os\nimport openai\nimport guardrails\n\n\ndef act(question):\n    logging.info('asked')\n    answer = openai.responses.create(input=question)\n    os.system(guardrails.validate(answer.output_text))\n", []),
    ("page.py", "import logging\nfrom anthropic import Anthropic\nfrom flask import jsonify\n\nclient = Anthropic()\n\n\ndef reply(q):\n    m = client.messages.create(messages=[q])\n    return jsonify(text=m.content)\n", [("EUAIA-ART50-003", 10)]),
    ("moods.py", "from feat import Detector\nimport ferret\nfrom deepface import DeepFace\n\nDeepFace.analyze(img, actions=['age', 'Emotion'])\nDeepFace.analyze(img, actions=['age'])\n", [("EUAIA-ART05-001", 1), ("EUAIA-ART05-001", 5)]),
    ("score.py", "def rate(p):\n    a = compute_social_score(p)\n    b = my_compute_social_score(p)\n    return auto_reject_candidate(a) or evaluate_citizen_trust(b)\n", [("EUAIA-ART05-002", 2), ("EUAIA-ART05-002", 4), ("GDPR-ART22-001", 4)]),
    ("client.py", "import requests as rq\n\nrq.get('https://a', verify=False)\nrq.get('https://a', verify=True)\nrq.post(\n    'https://a',\n    verify=False,\n)\n", [("GDPR-ART32-002", 3), ("GDPR-ART32-002", 5), ("GDPR-ART32-002", 7)]),
    ("settings.py", "api_key = 'abcdefghijklmnop1234'\nbase_url = 'http://models.internal/v1'\napi_base = 'http://localhost:8000'\ntoken = 'short'\n", [("EUAIA-ART15-002", 1), ("GDPR-ART32-003", 2)]),
    ("quiet.py", "import fer  # auditloom:ignore EUAIA-ART05-001\nimport feat  # auditloom:ignore GDPR-ART05-001 ALL\nai_disclaimer = False  # auditloom:ignore EUAIA-ART13-001,EUAIA-ART10-001\n", [("EUAIA-ART13-001", 3)]),
    ("people.js", "const a = '12345678Z';\nconst b = 'X1234567L';\nconst card = '4111111111111111'; // test\nconst no = '41111111111111112';\n", [("GDPR-ART05-002", 1), ("GDPR-ART05-002", 2), ("GDPR-ART05-003", 3)]),
    ("branches.py", "import subprocess, logging\n\n\ndef f(flag):\n    c = model.generate()\n    if flag:\n        c = 'ls'\n    subprocess.run(c)\n    c = 'pwd'\n    subprocess.run(c)\n", [("EUAIA-ART14-002", 8)]),
    ("requirements-dev.txt", "fastapi>=0.1\n# deepface\nDeepFace==0.0.79\ngit+https://h/r.git#egg=Face_Recognition\npy.feat  # auditloom:ignore EUAIA-ART05-003\n", [("EUAIA-ART05-003", 3), ("EUAIA-ART05-003", 4)]),
    ("pyproject.toml", "[project]\nname = 'x'\ndependencies = [\n  'numpy',\n  'py_feat>=0.6',\n]\n[project.optional-dependencies]\nfaces = ['deepface']\n", [("EUAIA-ART05-003", 5), ("EUAIA-ART05-003", 8)]),
    ("uv.lock", "version = 1\n[[package]]\nname = \"numpy\"\n[[package]]\nname = \"deepface\"\n", [("EUAIA-ART05-003", 5)]),
    ("Pipfile", "[packages]\n# deepface\nnumpy = '*'\ndeepface = '*'\n[dev-packages]\n", [("EUAIA-ART05-003", 4)]),
    ("Dockerfile", "FROM a AS b\nUSER app\nFROM c\nARG WHO=root\nEXPOSE 8000 9000\nUSER ${WHO}\n", [("EUAIA-ART15-005", 5), ("EUAIA-ART15-004", 6)]),
    ("api.dockerfile", "FROM a\nENV WHO=svc\nEXPOSE 18000\nUSER ${WHO:-root}:grp\n", []),
    ("compose.yml", "services:\n  web:\n    image: a\n    ports: ['8080:8080']\n  db:\n    image: b\n    privileged: true\n  aux:\n    user: 'root:1'\n", [("EUAIA-ART15-005", 4), ("EUAIA-ART15-006", 5), ("EUAIA-ART15-006", 8)]),
    ("notes.txt", "nothing of note\nverify = False\nskip_data_validation and bypass_risk_evaluation\n", [("GDPR-ART32-002", 2), ("EUAIA-ART10-001", 3), ("EUAIA-ART09-001", 3)]),
    ("plain.py", "def add(a, b):\n    return a + b\n", []),
]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: every document's template, under a folder of its own. The ids alone are dealt over all
    cores first: a small table may be one task's, and parsing is work for each file."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    pick = F.get(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c, _ in TEMPLATES]), F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int"))
    return docs.select(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/"), pick["n"]).alias("path"), pick["c"].alias("text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expected_sql(*rules: str, files: tuple[str, ...] = ()) -> str:
    """path, rule_id, start_line by the labels; of the given rules and files only, if any."""
    rows = [(i, n, r, line) for i, (n, _, labels) in enumerate(TEMPLATES) for r, line in labels if (not rules or r in rules) and (not files or n in files)]
    values = ", ".join(f"({i}, {_quoted(n)}, {_quoted(r)}, {line})" for i, n, r, line in rows)
    return f"SELECT 'p' || doc_id || '/' || name AS path, rule_id, start_line::INTEGER AS start_line FROM documents JOIN (VALUES {values}) AS t(k, name, rule_id, start_line) ON doc_id % {len(TEMPLATES)} = k"


def template_sql() -> str:
    """A table of the templates themselves: path, text."""
    values = ", ".join(f"({i}, {_quoted(n)}, {_quoted(c)})" for i, (n, c, _) in enumerate(TEMPLATES)).replace("\n", "' || chr(10) || '")
    return f"SELECT 'p' || doc_id || '/' || name AS path, text FROM documents JOIN (VALUES {values}) AS t(k, name, text) ON doc_id % {len(TEMPLATES)} = k"
