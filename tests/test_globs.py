"""Globs against Python's own, and every way in which a rule is found."""

import fnmatch
import random

from factlake.operators import governance

ODD = ["*", "?", "", "[]a]*", "[!]]", "[a-c]x", "[c-a]x", "[!c-a]x", "[abc", "a[", "[!]", "[^a]b", "[a\\]b", "[&&a]", "[a-]", "[-a]b", r"a\Eb", r"\Q*", "é?日*", "[é日]x", "a.b", "(x)+", "$^", "**a**", "[a-c-e]", "x\ny*", "[\n]", "[]-a]"]


def test_regex_equals_fnmatch(spark):
    rng = random.Random(2)
    patterns = ODD + ["".join(rng.choices("ab*?[]!-c\n", k=rng.randint(1, 7))) for _ in range(250)]
    texts = ["", "a", "b", "ax", "bx", "cx", "]", "]a", "a]", "a\nb", "x\nyz", "é日", "éa日本", "日x", "a.b", "axb", r"a\Eb", r"\Qx", "^b", "ab", "-", "-b", "&", "\\", "\\b", "$^", "(x)+", "[abc", "a[", "[!]", "e", "\n"]
    texts += ["".join(rng.choices("abc[]!-\n", k=rng.randint(1, 6))) for _ in range(60)]
    pairs = spark.createDataFrame([(p, t) for p in patterns for t in texts], "pattern string, text string")
    got = pairs.withColumn("r", governance.glob_regex(pairs["pattern"])).selectExpr("pattern", "text", "rlike(text, r) as fits").collect()
    wrong = [(r["pattern"], r["text"]) for r in got if r["fits"] != fnmatch.fnmatchcase(r["text"], r["pattern"])]
    assert not wrong, wrong[:10]


def test_every_rule_is_found(spark):
    rng = random.Random(3)
    tools, words = ["Bash", "Read", "run_command", "Edit"], ["rm a", "rm a\nrm b", "ls", "git push", "x", "", "a[b", "push --force"]
    calls = [(i, rng.choice(tools), rng.choice(words)) for i in range(300)] + [(900, None, "x"), (901, "Bash", None)]
    patterns = ["Bash(rm *)", "*push*", "*", "?dit", "[RE]*(ls)", "Read", "B*", "*(?)", "Bash(" + "x" * 90 + "*", "*s)", "Bash(a[[]b)", "run_command(*", "B?sh(git*)", "nothing", "[!B]*"]
    for k in range(4):
        rules = [(n, rng.choice(patterns), rng.choice(["block", "ask"])) for n in rng.sample(range(50), rng.randint(0, 6))]
        frame = spark.createDataFrame(rules, "rule_no int, pattern string, level string")
        got = {r["call_id"]: (r["level"], r["rule_no"]) for r in governance.match_enforcement(spark.createDataFrame(calls, "call_id int, tool string, input string"), frame).collect()}
        want = {}
        for i, tool, text in calls:
            names = [tool, f"{tool}({text})" if tool and text is not None else None] + (["Bash", f"Bash({text})"] if tool == "run_command" else [])
            hits = [(level != "block", n, level) for n, p, level in rules if any(s is not None and fnmatch.fnmatchcase(s, p) for s in names)]
            if hits:
                want[i] = (min(hits)[2], min(hits)[1])
        assert got == want, rules
