"""The catalog of detection rules.

A rule's pattern is Java's dialect and means *find*; flags stand inside it.  Every alternative of a pattern contains one of the
rule's anchors (in lower case), so a line without any of them needs no regular expression.  ``re2`` is an equivalent condition
for engines without look-around, over a column ``t``; where it is None the pattern itself serves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

JS, PY, ANY = ("javascript", "typescript"), ("python",), ("*",)

_WS = r"\s*"
_MODEL = "(?:assistant|completion|llm|model|output|response|result)"
_INPUT = r"body|input|message|query|req\.|request\.|user"
_TAINT = r"input|params\.|req\.|user"
_JOINED = rf"(?:{_TAINT}|\w+\s*\+)"
_QUOTE = "['\"]"
_CREDENTIAL = "api[_-]?key|authorization|password|secret|token"
_TLS_FREE = ("0.0.0.0", "127.0.0.1", "::1", "cdn.", "example.com", "fonts.googleapis", "jsdelivr", "localhost", "placeholder", "schema.", "schemas.", "unpkg", "www.w3.org", "xml.org")
_TLS_FREE_RE = "|".join(x.replace(".", r"\.") for x in _TLS_FREE)


def _template(words: str) -> str:
    """A template literal with a placeholder that reaches one of the words."""
    return r"`[^`]*\$\{[^}]*?(?:" + words + ")"


def _debug(end: str) -> str:
    """A debug switch that is on, or an application set to its development environment; ``end`` ends a bare value."""
    switch = rf"(?:^|[^\w.])debug{_WS}[:=]{_WS}(?:{_QUOTE}true{_QUOTE}|(?:1|true){end})"
    return switch + "|" + _WS.join([r"app\.set", r"\(", f"{_QUOTE}env{_QUOTE}", ",", rf"{_QUOTE}development{_QUOTE}\)"])


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    cwe_id: str
    languages: tuple[str, ...]
    anchors: tuple[str, ...]
    pattern: str
    message: str
    remediation: str
    match_scope: str | None = None
    re2: str | None = field(default=None, compare=False)


def _rule(rule_id, severity, category, cwe, languages, anchors, pattern, message, remediation, literal=False, cased=False, re2=None):
    return Rule(rule_id, severity, category, f"CWE-{cwe}", languages, tuple(anchors.split("|")), pattern if cased else "(?i)" + pattern, message, remediation, "literal" if literal else None, re2)


RULES: list[Rule] = [
    # Language models
    _rule("AI_PROMPT_INJECTION_DIRECT_INPUT", "high", "ai", 74, JS + PY, "prompt|message|input", rf"(?:input|messages?|prompt)\s*[:=]\s*(?:{_template(_INPUT + '|ctx' + chr(92) + '.request')}|(?:{_INPUT})[^,;\n]*\z)", "A prompt is built straight from what a user sent.", "Keep instructions and user content apart and limit what the content may do."),
    _rule("AI_PROMPT_TEMPLATE_USER_INPUT", "high", "ai", 74, JS, "openai|anthropic|client.responses|chat.completions|generatecontent|invoke", rf"(?:anthropic|chat\.completions|client\.responses|generateContent|invoke|openai){_WS}\([\s\S]{{0,120}}(?:{_template(_INPUT)})", "A model call interpolates user data into its payload.", "Pass user data as a separate message, labelled as data."),
    _rule("AI_OUTPUT_TO_EVAL", "critical", "ai", 95, JS + PY, "eval|function", rf"(?:Function|eval){_WS}\({_WS}{_MODEL}[A-Za-z0-9_]*{_WS}\)", "Model output runs as code.", "Parse it against a strict schema; never run it."),
    _rule("AI_OUTPUT_TO_SHELL", "critical", "ai", 78, JS + PY, "exec|spawn|subprocess.", rf"(?:(?:exec|spawn)(?:Sync)?|subprocess\.(?:Popen|call|run)){_WS}\([\s\S]{{0,80}}{_MODEL}", "Model output reaches a process call.", "Map it onto a fixed list of safe commands."),
    _rule("AI_OUTPUT_TO_HTML", "high", "ai", 79, JS, "innerhtml|outerhtml|document.write", rf"(?:dangerouslySetInnerHTML|document\.write|(?:inner|outer)HTML){_WS}[=(]{_WS}{_MODEL}", "Model output becomes markup unescaped.", "Show it as text, or sanitize it first."),
    _rule("AI_SECRET_IN_CONTEXT", "high", "ai", 201, JS + PY, "message|prompt|context|system", rf"(?:context|messages?|prompt|system){_WS}[:=][\s\S]{{0,120}}(?:{_CREDENTIAL}|private[_-]?key)", "A prompt or context seems to hold a credential.", "Leave credentials out of what a model sees."),
    _rule("AI_SECRET_VARIABLE_IN_PROMPT", "high", "ai", 201, JS, "prompt|message|context", rf"(?:context|messages?|prompt){_WS}[:=]{_WS}`[\s\S]{{0,200}}\$\{{[^}}]*?(?:{_CREDENTIAL})[^}}]*\}}", "A template interpolates a variable named like a credential into a prompt.", "Drop it, or mask it before the call."),
    _rule("AI_OUTPUT_TO_TEMPLATE_RESPONSE", "high", "ai", 79, JS, "res.send|return", rf"(?:return|res\.send){_WS}\({_WS}`[\s\S]{{0,120}}\$\{{{_MODEL}[^}}]*\}}[\s\S]{{0,120}}`{_WS}\)", "A response template holds model output unescaped.", "Escape it like any other foreign content."),
    # Authentication
    _rule("JWT_NO_VERIFY", "critical", "auth", 347, JS, "jwt.decode", rf"jwt\.decode{_WS}\((?!.*verify)", "A token is decoded and its signature not checked.", "Verify tokens with their key.", re2=rf"regexp_matches(t, '(?i)jwt\.decode\s*\(') AND NOT regexp_matches(regexp_extract(t, '(?is)^.*jwt\.decode\s*\((.*)$', 1), '(?i)verify')"),
    _rule("JWT_NONE_ALGORITHM", "critical", "auth", 327, JS + PY, "algorithm", rf"algorithms?{_WS}:{_WS}\[?{_WS}{_QUOTE}none{_QUOTE}", "Unsigned tokens are accepted.", "Name the signature algorithms that you use.", literal=True),
    _rule("HARDCODED_JWT_SECRET", "high", "auth", 798, JS, "jwt.sign", rf"jwt\.sign{_WS}\({_WS}\{{[^}}]*\}}{_WS},{_WS}{_QUOTE}[^'\"]{{3,}}{_QUOTE}", "Tokens are signed with a key written in the source.", "Read the key from the environment or a vault.", literal=True),
    _rule("BCRYPT_LOW_ROUNDS", "medium", "auth", 916, JS, "bcrypt", rf"bcrypt(?:js)?\.hash(?:Sync)?{_WS}\([^,]+,{_WS}[1-9]{_WS}\)", "Password hashing uses a one-digit cost.", "Use a cost of twelve or more.", cased=True),
    _rule("SESSION_NO_SECURE", "high", "auth", 614, JS, "session", rf"session{_WS}\({_WS}\{{[^}}]*(?:httpOnly|secure){_WS}:{_WS}false", "A session cookie goes without its protecting flags.", "Turn on secure, httpOnly and sameSite."),
    _rule("CORS_CREDENTIALS_WILDCARD", "high", "auth", 942, JS, "credentials", rf"credentials{_WS}:{_WS}true[\s\S]{{0,200}}origin{_WS}:{_WS}(?:{_QUOTE}?\*{_QUOTE}?|true)", "Any origin may send requests with credentials.", "List the origins that may.", literal=True),
    # Dangerous functions
    _rule("EVAL_USAGE", "critical", "dangerous-functions", 95, JS + PY, "eval", rf"(?<!\w)eval{_WS}\(", "Text is run as code.", "Parse the data instead.", cased=True, re2=r"regexp_matches(t, '(^|\W)eval\s*\(')"),
    _rule("FUNCTION_CONSTRUCTOR", "critical", "dangerous-functions", 95, JS, "function", rf"new\s+Function{_WS}\(", "A function is compiled from text.", "Write the function out.", cased=True),
    _rule("CHILD_PROCESS_EXEC", "high", "dangerous-functions", 78, JS, "exec", rf"exec(?:Sync)?{_WS}\({_WS}(?:{_QUOTE}.*?\+{_WS}(?:arg|{_TAINT})|`[^`]*\$\{{)", "A shell command is pieced together from input.", "Pass arguments as a list, without a shell."),
    _rule("VM_RUN_IN_CONTEXT", "high", "dangerous-functions", 94, JS, "vm.", rf"vm\.(?:createContext|runIn(?:New|This)?Context){_WS}\(", "The vm module is no sandbox.", "Run foreign code in a process of its own.", cased=True),
    _rule(
        "UNSERIALIZE", "critical", "dangerous-functions", 502, ANY, "serialize|pickle.load|yaml.load", rf"(?:deserialize|pickle\.loads?|unserialize|yaml\.load{_WS}\((?!.*Loader)){_WS}\(", "Foreign data is turned into objects.", "Read a data-only format, with a safe loader.",
        re2=r"regexp_matches(t, '(?i)(?:deserialize|pickle\.loads?|unserialize)\s*\(') OR (regexp_matches(t, '(?i)yaml\.load\s*\(\s*\(') AND NOT regexp_matches(regexp_extract(t, '(?is)^.*yaml\.load\s*\((\s*\(.*)$', 1), '(?i)loader'))",
    ),
    _rule("SETTIMEOUT_STRING", "medium", "dangerous-functions", 95, JS, "settimeout|setinterval", rf"set(?:Interval|Timeout){_WS}\({_WS}['\"`]", "A timer is given text to run.", "Give it a function.", cased=True),
    _rule("DYNAMIC_REQUIRE", "high", "dangerous-functions", 94, JS, "require", rf"require{_WS}\({_WS}{_JOINED}", "Input decides which module is loaded.", "Choose from a fixed list."),
    _rule("DYNAMIC_IMPORT", "high", "dangerous-functions", 94, JS, "import", rf"import{_WS}\({_WS}{_JOINED}", "Input decides which module is imported.", "Choose from a fixed list."),
    # Miscellaneous
    _rule("CORS_WILDCARD", "medium", "miscellaneous", 942, ANY, "origin", rf"(?:Access-Control-Allow-)?origin{_WS}[:=]{_WS}{_QUOTE}?\*", "Every origin is allowed.", "List the origins that you trust.", literal=True),
    _rule("CSRF_DISABLED", "high", "miscellaneous", 352, JS, "csrf|csurf", rf"csurf.*disable|csrf{_WS}[:=]{_WS}false", "Protection against forged requests is off.", "Leave it on for requests that change state."),
    _rule("HTTP_NO_TLS", "low", "miscellaneous", 319, ANY, "http://", rf"http://(?!{_TLS_FREE_RE})", "A plain HTTP address.", "Use HTTPS.", cased=True, re2=rf"len(regexp_extract_all(t, 'http://')) > len(regexp_extract_all(t, 'http://(?:{_TLS_FREE_RE})'))"),
    _rule("DEBUG_MODE_PROD", "medium", "miscellaneous", 489, ANY, "debug|app.set", _debug(r"(?!\w)"), "Debugging is on.", "Let the environment turn it on, never in production.", literal=True, re2="regexp_matches(t, '(?i)" + _debug(r"(?:\W|\z)").replace("'", "''") + "')"),
    _rule("STACK_TRACE_LEAK", "medium", "miscellaneous", 209, JS, "res.send|res.json|console.", rf"(?:console\.(?:error|log){_WS}\({_WS}err(?:or)?\.stack|res\.(?:json|send){_WS}\({_WS}err(?:or)?\.(?:message|stack))", "Internals of an error get out.", "Log them and answer in general terms.", cased=True),
    _rule("OPEN_REDIRECT", "medium", "miscellaneous", 601, JS + PY, "redirect|location", rf"(?:location|redirect){_WS}[(=]{_WS}(?:body\.|query\.|{_TAINT})", "Input decides where a browser is sent.", "Allow own paths only."),
    _rule("RATE_LIMIT_MISSING", "medium", "miscellaneous", 307, JS, "app.", rf"app\.(?:delete|patch|post|put){_WS}\({_WS}{_QUOTE}/(?:auth|forgot|login|register|reset|signup)", "A sign-in route; see that its rate is limited.", "Put a limiter before it.", literal=True),
    # Paths
    _rule("PATH_TRAVERSAL_FS", "high", "path-traversal", 22, JS, "readfile|writefile|createreadstream|createwritestream|unlink|readdir", rf"(?:create(?:Read|Write)Stream|(?:readFile|readdir|unlink|writeFile)(?:Sync)?){_WS}\({_WS}(?:{_JOINED}|`[^`]*\$\{{)", "Input decides which file is touched.", "Resolve the path and check that it stays inside its root."),
    _rule("PATH_TRAVERSAL_JOIN", "medium", "path-traversal", 22, JS, "path.join", rf"path\.join{_WS}\([^)]*(?:body|{_TAINT})", "Input is joined into a path.", "Normalize and check the prefix."),
    _rule("PATH_TRAVERSAL_SEND_FILE", "high", "path-traversal", 22, JS, "sendfile|download|serve", rf"(?:download|sendFile|serve){_WS}\({_WS}(?:{_TAINT})", "Input decides which file is sent.", "Look the file up by an id."),
]
BY_ID = {r.rule_id: r for r in RULES}


def checked(rules: list[Rule]) -> list[Rule]:
    """The rules, if ids are unique and their severities known; patterns are compiled when a plan runs, so they are tried here."""
    from quillon.functions.severity import SEVERITIES

    if len({r.rule_id for r in rules}) != len(rules):
        raise ValueError("two rules have one id")
    for r in rules:
        if r.severity not in SEVERITIES:
            raise ValueError(f"{r.rule_id}: unknown severity {r.severity}")
        re.compile(r.pattern.replace(r"\z", r"\Z"))
    return rules


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The catalog as a table."""
    rows = [(i, r.rule_id, r.pattern, r.severity, r.category, r.cwe_id, r.message, r.remediation, list(r.languages), r.match_scope, list(r.anchors)) for i, r in enumerate(checked(RULES if rules is None else rules))]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, pattern string, severity string, category string, cwe_id string, message string, remediation string, languages array<string>, match_scope string, anchors array<string>")
