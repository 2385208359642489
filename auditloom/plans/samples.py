"""Short files that each built-in rule must find, and near ones that it must not, labelled by
hand from what the rules mean; nothing here is derived from the catalog. `{n}` stands for a
number that differs from file to file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import _quoted

#: (file name, text, [(rule id, severity, tier, first line)])
SAMPLES: list[tuple[str, str, list[tuple[str, str, str, int]]]] = [
    ("requirements.txt", "numpy=={n}\nface_recognition\n", [("EUAIA-ART05-003", "CRITICAL", "prohibited", 2)]),
    ("requirements.txt", "face-recognition-models\nnumpy=={n}\n", []),
    ("data.js", "validate_dataset = FALSE; // {n}\n", [("EUAIA-ART10-001", "MEDIUM", "high_risk", 1)]),
    ("data.js", "validate_dataset = True; // {n}\n", []),
    ("data.js", "// {n}\nrun({ Skip_Data_Validation: 1 })\n", [("EUAIA-ART10-001", "MEDIUM", "high_risk", 2)]),
    ("data.js", "skip_data_validatio{n}\n", []),
    ("card.yaml", "a: {n}\nmodel_card_disabled: true\n", [("EUAIA-ART11-001", "MEDIUM", "high_risk", 2)]),
    ("card.yaml", "model_card: disabled {n}\n", []),
    ("calls.py", "import anthropic\nx{n} = anthropic.messages.create()\n", [("EUAIA-ART12-001", "HIGH", "high_risk", 2)]),
    ("calls.py", "import logging\nimport anthropic\nx{n} = anthropic.messages.create()\n", []),
    ("calls.py", "x{n} = messages.make()\n", []),
    ("notice.ts", "const ai_disclaimer =\tfalse // {n}\n", [("EUAIA-ART13-001", "HIGH", "limited_risk", 1)]),
    ("notice.ts", "const ai_disclaimer = shown{n}\n", []),
    ("act.py", "x = {n}\nagent.auto_execute_decision(x)\n", [("EUAIA-ART14-001", "HIGH", "high_risk", 2)]),
    ("act.py", "auto_execute_decision = {n}\n", []),
    ("act.py", "execute_autonomous_action({n})\n", [("EUAIA-ART14-001", "HIGH", "high_risk", 1)]),
    ("infer.py", "\nunhandled_model_inference({n})\n", [("EUAIA-ART15-001", "LOW", "high_risk", 2)]),
    ("infer.py", "handled_model_inference({n})\n", []),
    ("keys.json", "x{n}\nauth_token = \"abcdefgh-ABCDEFGH_12\"\n", [("EUAIA-ART15-002", "CRITICAL", "high_risk", 2)]),
    ("keys.json", "auth_token = \"abcdefgh-{n}\"\n", []),
    ("ask.js", "prompt = f'say {query} {n}'\n", [("EUAIA-ART15-003", "HIGH", "high_risk", 1)]),
    ("ask.js", "prompt = 'say {query} {n}'\n", []),
    ("Dockerfile", "FROM a:{n}\nRUN b\n", [("EUAIA-ART15-004", "HIGH", "high_risk", 1)]),
    ("Dockerfile", "FROM a:{n}\nUSER app\n", []),
    ("Dockerfile", "FROM a:{n}\nUSER app\nEXPOSE 8080\n", [("EUAIA-ART15-005", "HIGH", "high_risk", 3)]),
    ("Dockerfile", "FROM a:{n}\nUSER app\nEXPOSE 8443\n", []),
    ("docker-compose.yml", "services:\n  a:\n    image: i{n}\n    privileged: true\n", [("EUAIA-ART15-006", "CRITICAL", "high_risk", 2)]),
    ("docker-compose.yml", "services:\n  a:\n    image: i{n}\n    privileged: false\n    user: '1000'\n", []),
    ("reply.ts", "// {n}\nreturn r.choices[0].message.content\n", [("EUAIA-ART50-002", "MEDIUM", "limited_risk", 2)]),
    ("reply.ts", "return r.choices[1].message.content // {n}\n", []),
    ("moods.py", "from fer import FER\nx = {n}\n", [("EUAIA-ART05-001", "CRITICAL", "prohibited", 1)]),
    ("moods.py", "import ferry\nx = {n}\n", []),
    ("score.py", "n = {n}\ncompute_social_score(n)\n", [("EUAIA-ART05-002", "CRITICAL", "prohibited", 2)]),
    ("score.py", "compute_social_scores({n})\n", []),
    ("risk.env", "A={n}\nBYPASS_RISK_EVALUATION=1\n", [("EUAIA-ART09-001", "LOW", "high_risk", 2)]),
    ("log.js", "log_raw_payload =  true; x({n})\n", [("GDPR-ART05-001", "MEDIUM", "limited_risk", 1)]),
    ("log.js", "log_raw_payload = 1; x({n})\n", []),
    ("people.toml", "n = {n}\nid = 'Y7654321b'\n", [("GDPR-ART05-002", "HIGH", "high_risk", 2)]),
    ("people.toml", "n = {n}\nid = 'Y7654321i and 1234567Z and 12345678ZZ'\n", []),
    ("cards.toml", "n = {n}\nc = 378282246310005\n", [("GDPR-ART05-003", "CRITICAL", "high_risk", 2)]),
    ("cards.toml", "n = {n}\nc = 368282246310005\nd = 5512345678901234567\n", []),
    ("health.js", "x({n})\nprocess_health_records=true\n", [("GDPR-ART09-001", "CRITICAL", "high_risk", 2)]),
    ("health.py", "a.extract_biometric_features({n})\n", [("GDPR-ART09-001", "CRITICAL", "high_risk", 1)]),
    ("jobs.py", "n = {n}\nhr.credit_scoring_auto_approve(n)\n", [("GDPR-ART22-001", "HIGH", "high_risk", 2)]),
    ("jobs.py", "hr.credit_scoring({n})\n", []),
    ("hf.yaml", "n: {n}\nx: hf_key = 'abcdefghijklmnopqrst'\n", [("GDPR-ART32-001", "CRITICAL", "high_risk", 2)]),
    ("hf.yaml", "n: {n}\nx: hf_key = 'abcdefghijklmnopqrs'\n", []),
    ("web.py", "import requests\nrequests.get('https://h/{n}', verify=False)\n", [("GDPR-ART32-002", "HIGH", "high_risk", 2)]),
    ("web.py", "import requests\nrequests.get('https://h/{n}', verify=True)\n", []),
    ("url.js", "n({n})\nbase_url = 'http://models.example'\n", [("GDPR-ART32-003", "HIGH", "high_risk", 2)]),
    ("url.js", "base_url = 'http://127.0.0.1:{n}'\napi_base = 'https://models.example'\n", []),
    ("shell.py", "import subprocess\nimport logging\nc = openai.responses.create({n})\nsubprocess.run(c.output_text, shell=True)\n", [("EUAIA-ART14-002", "CRITICAL", "high_risk", 4)]),
    ("page.py", "import logging\nfrom anthropic import Anthropic\nfrom flask import jsonify\nc = Anthropic()\ndef reply(q):\n    m = c.messages.create(messages=[q])\n    return jsonify(text=m.content, n={n})\n", [("EUAIA-ART50-003", "MEDIUM", "limited_risk", 7)]),
    ("shell.py", "import subprocess\nimport logging\nc = 'ls {n}'\nsubprocess.run(c, shell=True)\n", []),
]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: one sample for each document, under a folder of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()), "doc_id")
    pick = F.get(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t, _ in SAMPLES]), F.pmod("doc_id", F.lit(len(SAMPLES))).cast("int"))
    number = F.col("doc_id").cast("string")
    return docs.select(F.concat(F.lit("s"), number, F.lit("/"), pick["n"]).alias("path"), F.replace(pick["t"], F.lit("{n}"), number).alias("text"))


def expected_sql() -> str:
    rows = [(k, name, *label) for k, (name, _, labels) in enumerate(SAMPLES) for label in labels]
    values = ", ".join(f"({k}, {_quoted(n)}, {_quoted(r)}, {_quoted(s)}, {_quoted(t)}, {line})" for k, n, r, s, t, line in rows)
    return f"SELECT 's' || doc_id || '/' || name AS path, rule_id, severity, risk_tier, line::INTEGER AS start_line FROM documents JOIN (VALUES {values}) AS t(k, name, rule_id, severity, risk_tier, line) ON doc_id % {len(SAMPLES)} = k"
