"""The built-in rules.

Fixed values, in order: rule ids, articles, severities, tiers, confidences, pattern
types, targets and match arguments decide results and are stated as they must be.
Titles and remedies are notes for readers. Rules come in the order of their files'
names, in which article 50 sorts before article 5.
"""

from __future__ import annotations

_LLM_CALLS = ["openai.chat.completions.create", "openai.responses.create", "openai.AsyncOpenAI.chat.completions.create", "openai.AsyncOpenAI.responses.create", "openai.AzureOpenAI.chat.completions.create", "openai.AzureOpenAI.responses.create", "openai.AsyncAzureOpenAI.chat.completions.create", "openai.AsyncAzureOpenAI.responses.create", "anthropic.messages.create", "anthropic.AsyncAnthropic.messages.create", "google.genai.Client.models.generate_content", "google.genai.Client.aio.models.generate_content", "litellm.completion", "model.generate"]
_AI_15, _AI_35, _GDPR_20 = "15M EUR or 3%", "35M EUR or 7%", "20M EUR or 4%"


def _rule(id_, article, severity, tier, confidence, title, remediation, fine, *patterns):
    return {"id": id_, "article": article, "title": title, "severity": severity, "risk_tier": tier, "confidence": confidence, "description": f"{title}. A technical signal for review, no legal finding.", "remediation": remediation, "max_fine": fine, "patterns": list(patterns)}


def _p(kind, target, **match_args):
    return {"type": kind, "target": target, **({"match_args": match_args} if match_args else {})}


def _flow(sources, sanitizers, sinks):
    as_rows = lambda xs: [{"target": x} for x in xs]
    return {"type": "data_flow", "target": "", "data_flow": {"sources": as_rows(sources), "sanitizers": as_rows(sanitizers), "sinks": as_rows(sinks)}}


BUILTIN = [
    _rule("EUAIA-ART05-003", "Art. 5(1)(e) & Art. 5(1)(f)", "CRITICAL", "prohibited", "HIGH", "Declared biometric dependency", "Document purpose, setting and exceptions of its use.", _AI_35,
          _p("infra_dependency", "face-recognition"), _p("infra_dependency", "deepface"), _p("infra_dependency", "py-feat")),
    _rule("EUAIA-ART10-001", "Art. 10(2)", "MEDIUM", "high_risk", "LOW", "Input data validation switched off", "Validate input schemas and distributions.", _AI_15,
          _p("regex", r"(?i)validate_dataset\s*=\s*False"), _p("regex", r"(?i)skip_data_validation")),
    _rule("EUAIA-ART11-001", "Art. 11", "MEDIUM", "high_risk", "LOW", "Model documentation disabled", "Keep a model card with purpose and limits.", _AI_15,
          _p("regex", r"(?i)MODEL_CARD_DISABLED")),
    _rule("EUAIA-ART12-001", "Art. 12", "HIGH", "high_risk", "MEDIUM", "Model call in a file without known logging", "Record events with time and retention, without secrets.", _AI_15,
          *(_p("ast_absence", t) for t in ("chat.completions.create", "anthropic.messages.create", "anthropic.AsyncAnthropic.messages.create", "openai.responses.create", "openai.AsyncOpenAI.responses.create", "openai.AzureOpenAI.responses.create", "openai.AsyncAzureOpenAI.responses.create", "google.genai.Client.models.generate_content", "google.genai.Client.aio.models.generate_content", "generativeai.GenerativeModel", "mistral.chat"))),
    _rule("EUAIA-ART13-001", "Art. 50(1) / Art. 13", "HIGH", "limited_risk", "LOW", "AI disclaimer switched off", "Tell people that they deal with an AI system.", _AI_15,
          _p("regex", r"(?i)ai_disclaimer\s*=\s*False")),
    _rule("EUAIA-ART14-001", "Art. 14", "HIGH", "high_risk", "MEDIUM", "Autonomous action without a human gate", "Ask a person before irreversible actions.", _AI_15,
          _p("ast_call", "auto_execute_decision"), _p("ast_call", "execute_autonomous_action")),
    _rule("EUAIA-ART14-002", "Art. 14(4)(a) & Art. 15(1)", "CRITICAL", "high_risk", "HIGH", "Model output reaches a system command", "Choose among fixed commands; reject unknown ones.", _AI_35,
          _flow(_LLM_CALLS, ["guardrails.validate"], ["os.system", "subprocess.run", "subprocess.Popen", "subprocess.check_output", "subprocess.call", "eval", "exec"])),
    _rule("EUAIA-ART15-001", "Art. 15", "LOW", "high_risk", "MEDIUM", "Model call without failure handling", "Handle errors, retry and fall back.", _AI_15,
          _p("ast_call", "unhandled_model_inference")),
    _rule("EUAIA-ART15-002", "Art. 15", "CRITICAL", "high_risk", "HIGH", "Credential in plain text", "Load credentials from the environment or a vault.", _AI_15,
          _p("regex", r"(?i)(api_key|openai_api_key|anthropic_api_key|token|auth_token)\s*=\s*['\"][a-zA-Z0-9_\-]{16,}['\"]")),
    _rule("EUAIA-ART15-003", "Art. 15", "HIGH", "high_risk", "MEDIUM", "Unchecked input within a prompt", "Separate roles and filter user input.", _AI_15,
          _p("regex", r"(?i)(prompt|messages|user_input)\s*=\s*f['\"].*\{.*(raw_input|user_input|user_raw|query|prompt_text).*\}")),
    _rule("EUAIA-ART15-004", "Art. 15(1) & GDPR Art. 32", "HIGH", "high_risk", "HIGH", "Container runs as root", "Set a USER without privileges.", _AI_15,
          _p("infra_docker", "Dockerfile", missing_directive="USER")),
    _rule("EUAIA-ART15-005", "Art. 15(1) & GDPR Art. 32", "HIGH", "high_risk", "HIGH", "Plain HTTP port exposed", "Terminate TLS before the service.", _AI_15,
          _p("infra_docker", "insecure_http", insecure_http_endpoint=True)),
    _rule("EUAIA-ART15-006", "Art. 15(1) & GDPR Art. 32", "CRITICAL", "high_risk", "HIGH", "Privileged container", "Drop privileged mode; add single capabilities.", _AI_15,
          _p("infra_docker", "privileged_mode", privileged_mode=True)),
    _rule("EUAIA-ART50-003", "Art. 50(2) & Art. 13", "MEDIUM", "limited_risk", "HIGH", "Model output reaches users unmarked", "Moderate it or mark it as generated.", _AI_15,
          _flow(_LLM_CALLS, ["moderations.create", "openai.moderations.create", "guardrails.validate", "add_ai_disclaimer", "add_watermark"], ["jsonify", "render_template", "Response", "send_response"])),
    _rule("EUAIA-ART50-002", "Art. 50", "MEDIUM", "limited_risk", "MEDIUM", "Model output returned unmoderated", "Filter or validate output before it is delivered.", _AI_15,
          _p("regex", r"return\s+.*\.choices\[0\]\.message\.content")),
    _rule("EUAIA-ART05-001", "Art. 5(1)(f)", "CRITICAL", "prohibited", "HIGH", "Emotion inference", "Remove it or limit it to permitted settings.", _AI_35,
          _p("ast_import", "fer"), _p("ast_import", "feat"), _p("ast_call", "DeepFace.analyze", actions="emotion")),
    _rule("EUAIA-ART05-002", "Art. 5(1)(c)", "CRITICAL", "prohibited", "MEDIUM", "Social scoring", "Remove general scoring of people.", _AI_35,
          _p("ast_call", "compute_social_score"), _p("ast_call", "evaluate_citizen_trust")),
    _rule("EUAIA-ART09-001", "Art. 9", "LOW", "high_risk", "LOW", "Risk evaluation bypassed", "Evaluate and watch drift and failures.", _AI_15,
          _p("regex", r"(?i)bypass_risk_evaluation")),
    _rule("GDPR-ART05-001", "RGPD Art. 5(1)(c)", "MEDIUM", "limited_risk", "LOW", "Raw payload logged", "Log the least that is needed.", _GDPR_20,
          _p("regex", r"(?i)log_raw_payload\s*=\s*True")),
    _rule("GDPR-ART05-002", "RGPD Art. 5(1)(c) / Art. 9", "HIGH", "high_risk", "MEDIUM", "National identity number", "Pseudonymise identity numbers.", _GDPR_20,
          _p("regex", r"(?i)\b[0-9]{8}[TRWAGMYFPDXBNJZSQVHLCKE]\b"), _p("regex", r"(?i)\b[XYZ][0-9]{7}[TRWAGMYFPDXBNJZSQVHLCKE]\b")),
    _rule("GDPR-ART05-003", "RGPD Art. 5(1)(f) / Art. 32", "CRITICAL", "high_risk", "MEDIUM", "Payment card number", "Tokenise card numbers.", _GDPR_20,
          _p("regex", r"\b4[0-9]{12}(?:[0-9]{3})?\b"), _p("regex", r"\b5[1-5][0-9]{14}\b"), _p("regex", r"\b3[47][0-9]{13}\b")),
    _rule("GDPR-ART09-001", "RGPD Art. 9", "CRITICAL", "high_risk", "MEDIUM", "Special category data processed", "Check the legal basis and protect the data.", _GDPR_20,
          _p("ast_call", "extract_biometric_features"), _p("regex", r"(?i)process_health_records\s*=\s*True")),
    _rule("GDPR-ART22-001", "RGPD Art. 22", "HIGH", "high_risk", "MEDIUM", "Solely automated decision", "Offer human review of such decisions.", _GDPR_20,
          _p("ast_call", "auto_reject_candidate"), _p("ast_call", "credit_scoring_auto_approve")),
    _rule("GDPR-ART32-001", "RGPD Art. 32 / EU AI Act Art. 15", "CRITICAL", "high_risk", "HIGH", "Provider key in the source", "Revoke the key and load it from a vault.", _GDPR_20,
          _p("regex", r"(?i)(openai|anthropic|cohere|hf)_(api_)?key\s*=\s*['\"][a-zA-Z0-9_\-]{20,}['\"]"), _p("regex", r"sk-[a-zA-Z0-9_-]{20,}"), _p("regex", r"sk-ant-[a-zA-Z0-9_-]{20,}")),
    _rule("GDPR-ART32-002", "RGPD Art. 32(1)(a)", "HIGH", "high_risk", "HIGH", "TLS verification switched off", "Verify certificates in every client.", _GDPR_20,
          _p("ast_call", "requests.get", verify=False), _p("ast_call", "requests.post", verify=False), _p("ast_call", "httpx.Client", verify=False), _p("regex", r"(?i)verify\s*=\s*False")),
    _rule("GDPR-ART32-003", "RGPD Art. 32(1)(a)", "HIGH", "high_risk", "MEDIUM", "Model endpoint over plain HTTP", "Use https outside the own machine.", _GDPR_20,
          _p("regex", r"(?i)base_url\s*=\s*['\"]http://(?!localhost|127\.0\.0\.1)"), _p("regex", r"(?i)api_base\s*=\s*['\"]http://(?!localhost|127\.0\.0\.1)")),
]
