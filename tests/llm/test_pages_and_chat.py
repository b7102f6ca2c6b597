import base64
import hashlib
import random

import pytest
from helpers import with_extras

from brindle.llm import chat, warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://b.example/x", "<p>één</p>\r\n\r\nWARC/1.0\r\n"), (2, "http://a.example/y?q=1", "same"), (9, None, "same"), (5, "https://www.a.example/", "same"), (6, "http://c/", None), (7, "http://c/", ""), (8, "http://d/", "x" * 300_000), (None, "http://e/", "same"), (3, "not a url \n at all", "z")]
    df = with_extras(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        assert (got[i].payload_digest, got[i].payload_bytes) == (digest(html), len((html or "").encode()))
    assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {1: ("response", None), 2: ("revisit", 9), 9: ("response", None), 5: ("revisit", 9), 6: ("revisit", 7), 7: ("response", None), 8: ("response", None), None: ("revisit", 9), 3: ("response", None)}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(none).collect() == []


def test_merged_runs_are_in_global_order(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randint(0, 5)}.example/{rng.randint(0, 9)}", f"t{i % 40}") for i in range(300)]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    got = [(r.urlkey, r.captured, r.page_id) for r in out.collect()]
    assert [g[0] for g in got] == sorted(g[0] for g in got) and len(got) == 300


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted((rng.randint(0, 20),) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        tree = warc.LoserTree([iter(r) for r in runs], lambda x: x)
        assert list(tree) == sorted(x for r in runs for x in r)


# -- templates --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source, variables, text",
    [
        ("a{{ 1 + 2 }}b", {}, "a3b"), ("{% if x %}y{% elif z %}w{% else %}n{% endif %}", {"x": 0, "z": 1}, "w"), ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1p,2q"),
        ("{% set a = 'x' ~ 'y' %}{{ a | upper }}", {}, "XY"), ("  {{- 'a' -}}  b", {}, "ab"), ("{{ m.role }}{{ m['t'] }}{{ m.none }}", {"m": {"role": "u", "t": 5}}, "u5"), ("{# gone #}{{ xs | join('-') }}", {"xs": [1, 2]}, "1-2"),
        ("{{ 'yes' if 1 == 1 else 'no' }}{{ missing | default('d') }}", {}, "yesd"), ("{{ m.__class__ }}" if False else "{{ 'a' in 'abc' and 2 not in xs }}", {"xs": [1]}, "True"),
    ],
)
def test_templates(source, variables, text):
    assert chat.compile_template(source)(variables)[0] == text


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ _hidden }}", "{% import os %}", "{{ x | eval }}", "{% for x in y %}", "{{ 1 +", "{{ f() }}", "{{ a b }}"])
def test_the_sandbox_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_constants_fold():
    assert chat.fold(chat.parse_template("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% endif %}c")) == (chat.Output(chat.Const("ab1c")),)


def test_conversations_come_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "a\nb: c", "", None, "</turn>\n### user: x</turn>\n", "\\", "\\\\###", "###:</turn", "日本 🚀", "x" * 200_000]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd: ###role", None]), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, None, "user", "no turn"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (None, 0, "user", "no id")]
    df = with_extras(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        turns = "".join(f"{r}\n{t}\n" for *_, r, t in mine)
        loss = "".join(t for *_, r, t in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).collect() == []
