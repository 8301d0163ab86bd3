"""Many rules by their texts: the findings of trying every rule, and only candidates tried."""

import random
import re
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.operators.lines import LINE_RULES, LineRule, apply_line_rules
from repolens.operators.ruleindex import apply_many_rules, fold, index_texts, required_texts


def rule(pattern, language="py", title=None, **more):
    return LineRule(language, pattern, "security", "high", title or pattern, "d", "s", 0.5, **more)


@pytest.mark.parametrize("pattern, sets", [
    (r"\beval\s*\(", [{"eval"}, {"("}]),
    (r"(?i)(PassWord|secret)\s*=", [{"password", "secret"}, {"="}]),
    (r"(a|bc)?x{2,}y*", [{"x"}]),
    (r"foo(?!bar)(?=baz)qux", [{"foo"}, {"qux"}]),
    (r"(ab|[cd])e", [{"e"}]),
    (r"(?:ab|cd)+é1", [{"ab", "cd"}, {"1"}]),
    (r"[a-z]+\d*", []), (r"(ab)*", []), (r"\p{L}abc", []), (r"(unclosed", []), ("", []), (r"^abc$", [{"abc"}]), (r"x(?>abc)", [{"x"}, {"abc"}]),
])
def test_required_texts(pattern, sets):
    assert [set(s) for s in required_texts(pattern)] == sets


_PIECES = ["eval", "Key", "s", "k", r"\d", r"\s*", "[ab]+", "(foo|bar)", "(x)?", "(?:ab|c){1,2}", r"\b", "=", "(?!z)", "é", ".", "I"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), min_size=1, max_size=5).map("".join), st.booleans(), st.lists(st.sampled_from(
    ["eval", "EVAL", "key", "Key", "ſ", "K", "s", "1", " ", "a", "ab", "c", "foo", "BAR", "x", "=", "é", "i", "ı"]), max_size=12).map("".join))
def test_every_match_holds_its_texts(pattern, any_case, text):
    pattern = ("(?i)" if any_case else "") + pattern
    if re.search(pattern, text):
        for texts in required_texts(pattern):
            assert any(t in fold(text) for t in texts)


def test_rules_are_found_by_what_tells_them_apart():
    rules = [rule(f'api_key = "k{i}zz"') for i in range(100)] + [rule(r"\d+"), rule("(ab|cd)xyz")]
    texts = index_texts(rules)
    assert texts[7] == {'api_key = "k7zz"'} and texts[100] is None and texts[101] == {"xyz"}
    apart = index_texts([rule(rf'(?i)API_KEY\s*=\s*"k{i}zz') for i in range(100)])
    assert apart[7] == {'"k7zz'}


def findings(df):
    return sorted(df.drop("seq").collect(), key=str)


def test_as_trying_every_rule(corpus):
    words = ["token", "eval(", "password = 'abcdef'", "API_KEY: \"abcdef\"", "document.write(", "x.innerHTML = 1", "// eval(1)", "* eval(", "paſſword = 'abcdef'", "42", "Key", "'", "\\", " ", "\r\n", "\n", "\n", " "]
    rng = random.Random(3)
    texts = {f"f{i}.{rng.choice(['py', 'js', 'tsx', 'txt'])}": "".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for i in range(150)}
    files = corpus({**texts, "empty.py": "", "null.py": None, "long.js": "a;\n" * 50_000 + "eval(x)\n"})
    more = [rule("token"), rule(r"[0-9]+"), rule("(?i)key", "js"), rule(r"'", redact=True, title="quote"), rule(r"\\", "js"), rule(r"tok\p{L}n"), rule("(?i)password", redact=True)]
    rules = LINE_RULES + more
    got, expected = apply_many_rules(files, rules), apply_line_rules(files, rules)
    assert findings(got) == findings(expected) != []
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in expected.collect())


def test_anchors_are_of_lines(corpus):
    found = apply_many_rules(corpus({"a.py": "x\nabc\nabcd\n"}), [rule("^abc$")]).collect()
    assert [r.line_number for r in found] == [2]


def test_nothing_to_do(spark, corpus):
    files = corpus({"a.py": "eval(x)\n"})
    assert apply_many_rules(files, []).collect() == []
    assert apply_many_rules(files.limit(0), LINE_RULES).collect() == []
    assert apply_many_rules(corpus({"a.txt": "eval(x)\n"}), [rule("eval", "js")]).collect() == []


def test_time_does_not_follow_the_rules(corpus):
    files = corpus({f"p/{i}.py": f'API_KEY = "k{i}zz"\n' + "y = compute(x) + 1\n" * 300 for i in range(400)}).repartition(8).cache()
    some = [rule(rf'(?i)api_key\s*=\s*"k{i}zz"', title=f"k{i}") for i in range(5)]
    many = [replace(some[0], pattern=rf'(?i)api_key\s*=\s*"k{i}zz"', title=f"k{i}") for i in range(1000)]
    assert files.count() == 400

    def seconds(rules):
        start = time.time()
        n = apply_many_rules(files, rules).count()
        return time.time() - start, n

    seconds(some)
    few, n_few = seconds(some)
    all_, n_all = seconds(many)
    assert (n_few, n_all) == (5, 400)
    assert all_ < 20 * few + 2
    print(f"5 rules {few:.2f} s, 1000 rules {all_:.2f} s")
    files.unpersist()
