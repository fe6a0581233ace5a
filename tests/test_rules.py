import pytest
from pyspark.sql import functions as F

from quillon.functions.severity import SEVERITIES
from quillon.operators.match import findings
from quillon.sources.corpus import SNIPPETS
from quillon.sources.rules import BY_ID, RULES, Rule, checked, rules_frame

#: rule -> (lines that match, lines that don't), beside what the corpus of snippets has.
CASES = {
    "AI_OUTPUT_TO_EVAL": (["eval( responseText )"], ["eval(a.response)"]),
    "JWT_NO_VERIFY": (["jwt.decode(a); jwt.verify(b) ; jwt.decode(c)"], ["jwt.decode(x, {verify: true})"]),
    "BCRYPT_LOW_ROUNDS": (["bcrypt.hashSync(p, 1)"], ["bcrypt.hash(p, 0)", "BCRYPT.hash(p, 4)"]),
    "EVAL_USAGE": (["eval(x)", "a=eval  (x)", "x.eval(y)"], ["_eval(x)", "EVAL(x)", "evals(x)"]),
    "UNSERIALIZE": (["unserialize($x)", "safeDeserialize(x)", "pickle.load (f)", "yaml.load((x))"], ["yaml.load(x)", "yaml.load((x), Loader=L)", "pickle.dump(f)"]),
    "HTTP_NO_TLS": (["http://a.b", "see http://cdn.x and http://y.z"], ["http://localhost.evil.com", "HTTP://a.b", "http://schemas.x.org", "https://a.b"]),
    "DEBUG_MODE_PROD": (["debug: 1", "DEBUG=true", 'a, debug = "true"', "app.set('env','development')"], ["debug: 10", "debug: trueish", "my.debug = true", "undebug: 1"]),
    "CORS_CREDENTIALS_WILDCARD": (["credentials: true, origin: *"], ["origin: '*', credentials: true"]),
    "AI_PROMPT_INJECTION_DIRECT_INPUT": (["prompt = user.text"], ["prompt = user, other"]),
    "RATE_LIMIT_MISSING": (["app.patch('/reset')", 'APP.DELETE( "/auth/x")'], ["app.post('/home')", "app.get('/login')", "router.post('/login')"]),
    "AI_PROMPT_TEMPLATE_USER_INPUT": (["openai.invoke(x); invoke(`${a.message}`)", "anthropic( `hi ${request.q}`"], ["openai(`hi ${name}`)", "openai('user')"]),
    "AI_OUTPUT_TO_SHELL": (["child.execSync(cmd + modelText)", "subprocess.Popen([llm])"], ["exec(command)", "subprocess.check(model)"]),
    "AI_OUTPUT_TO_HTML": (["a.outerHTML = result", "document.write( response)", "dangerouslySetInnerHTML = output"], ["a.innerHTML = page", "a.innerText = result"]),
    "AI_SECRET_IN_CONTEXT": (["system: 'use the private_key'", "messages = [Authorization]"], ["system: 'be kind'", "contextual = nothing"]),
    "AI_SECRET_VARIABLE_IN_PROMPT": (["message: `a ${x.apiKey} b`", "prompt=`${env.password}`"], ["prompt = `${x}` + password", "prompt = '${password}'"]),
    "AI_OUTPUT_TO_TEMPLATE_RESPONSE": (["return ( `a ${output.x} b` )"], ["return `a ${output.x} b`", "res.send(`a ${user.x} b`)"]),
    "JWT_NONE_ALGORITHM": (["algorithm: 'NONE'", "algorithms : [ \"none\""], ["algorithm: none", "algorithms: ['HS256', 'none']"]),
    "HARDCODED_JWT_SECRET": (["jwt.sign({a: 1}, 'key')", 'JWT.sign( {} , "longer key")'], ["jwt.sign({a: 1}, 'ab')", "jwt.sign(data, 'long key')", "jwt.sign({a: 1}, key)"]),
    "SESSION_NO_SECURE": (["session({ cookie: 1, httpOnly : false })"], ["session({ secure: true })", "session(secure: false)"]),
    "FUNCTION_CONSTRUCTOR": (["x = new  Function ('a')"], ["new function('a')", "newFunction('a')", "Function('a')"]),
    "CHILD_PROCESS_EXEC": (["execSync(\"ls \" + args)", "exec(`ls ${a}`)", "exec('a' + params.x)"], ["exec('ls')", "exec(\"ls\" + fixed)", "exec(`ls`)"]),
    "VM_RUN_IN_CONTEXT": (["vm.runInThisContext (c)", "vm.runInContext(c)"], ["vm.runInOtherContext(c)", "VM.runInContext(c)"]),
    "SETTIMEOUT_STRING": (["setTimeout( \"x\")", "setInterval(`x`)"], ["setTimeout(x, '1')", "settimeout('x')"]),
    "DYNAMIC_REQUIRE": (["require( params.x)", "require(a + 'b')", "require(userFile)"], ["require('a' + b)", "require(fixed)"]),
    "DYNAMIC_IMPORT": (["import(inputName)", "import( dir +x)"], ["import x from 'y'", "import('user')"]),
    "CORS_WILDCARD": (["origin: *", "ORIGIN = '*'", "Access-Control-Allow-Origin: \"*\""], ["origin: 'https://*'", "origins: *"]),
    "CSRF_DISABLED": (["csrf = false", "CSRF:FALSE", "csurf({disabled: 1})"], ["csrf: 'false'", "disable csurf"]),
    "STACK_TRACE_LEAK": (["res.send( error.message)", "console.log(err.stack)"], ["console.log(err.message)", "res.send(err)", "RES.send(err.stack)"]),
    "OPEN_REDIRECT": (["redirect(query.next)", "LOCATION = req.url", "location=userPage"], ["redirect('/a')", "location.href = req.url"]),
    "PATH_TRAVERSAL_FS": (["fs.readdirSync( req.x)", "writeFile(`a/${b}`)", "unlink(p + x)"], ["readFile('a' + b)", "readFile(`a/b`)", "readFiles(req.x)"]),
    "PATH_TRAVERSAL_JOIN": (["path.join(a, b, params.c)", "path.join('x', userId)"], ["path.join(a) + params.c", "path.resolve(a, req.x)"]),
    "PATH_TRAVERSAL_SEND_FILE": (["res.sendFile( input)", "download(params.f)"], ["sendFile('user')", "res.sendFile(root + req.x)"]),
}


def _hits(spark, rows, rules):
    lines = spark.createDataFrame([(i, "a.js", "javascript", 1, t) for i, t in enumerate(rows)], "ord long, file_path string, language string, line int, text string")
    return {(r["ord"], r["rule_id"]) for r in findings(lines, rules).select("ord", "rule_id").collect()}


def test_every_rule_has_lines():
    assert set(CASES) == set(BY_ID)


@pytest.mark.parametrize("rule_id", CASES)
def test_lines_for_and_against(spark, rule_id):
    yes, no = CASES[rule_id]
    assert _hits(spark, yes + no, [BY_ID[rule_id]]) == {(i, rule_id) for i in range(len(yes))}


def test_every_rule_matches_some_snippet_and_not_all(spark):
    hits = _hits(spark, SNIPPETS, RULES)
    for r in RULES:
        n = sum(x == r.rule_id for _, x in hits)
        assert 0 < n < len(SNIPPETS), r.rule_id


def test_anchors_lose_nothing(spark):
    bare = [Rule(r.rule_id, r.severity, r.category, r.cwe_id, ("*",), ("",), r.pattern, "", "") for r in RULES]
    wide = [Rule(r.rule_id, r.severity, r.category, r.cwe_id, ("*",), r.anchors, r.pattern, "", "") for r in RULES]
    rows = SNIPPETS + [x for yes, no in CASES.values() for x in yes + no]
    assert _hits(spark, rows, bare) == _hits(spark, rows, wide)


def test_language_gate(spark):
    rows = [(0, "a.py", "python", 1, "new Function('x')"), (1, "a.py", "python", 1, "eval(x)"), (2, "a.go", "go", 1, "eval(x)"), (3, "a.go", "go", 1, "http://a.b"), (4, "a", "unknown", 1, None)]
    lines = spark.createDataFrame(rows, "ord long, file_path string, language string, line int, text string")
    assert {(r["ord"], r["rule_id"]) for r in findings(lines).collect()} == {(1, "EVAL_USAGE"), (3, "HTTP_NO_TLS")}


def test_catalog_is_sound(spark):
    from collections import Counter

    assert len(RULES) == 32
    assert Counter(r.severity for r in RULES) == {"critical": 7, "high": 16, "medium": 8, "low": 1}
    assert sum(r.pattern.startswith("(?i)") for r in RULES) == 25
    assert sum(r.match_scope == "literal" for r in RULES) == 6
    assert all(r.severity in SEVERITIES for r in RULES)
    assert rules_frame(spark).count() == 32
    with pytest.raises(ValueError):
        checked([RULES[0], RULES[0]])


def test_one_finding_a_line_and_rule(spark):
    assert len(_hits(spark, ["eval(a); eval(b)"], [BY_ID["EVAL_USAGE"]])) == 1


def test_no_shuffle_and_no_python_in_the_scan(spark):
    lines = spark.range(10).select(F.col("id").alias("ord"), F.lit("a.js").alias("file_path"), F.lit("javascript").alias("language"), F.lit(1).alias("line"), F.lit("eval(x)").alias("text"))
    plan = findings(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
