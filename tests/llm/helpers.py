import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators might use themselves.
EXTRA = "'x' AS id, 'y' AS _text, 1 AS size, 2 AS fp, 3 AS rep, 'k' AS key, 4 AS row, true AS held, 'z' AS component_id, 5 AS n, 6 AS v, 7 AS ids, 8 AS _id, 9 AS score"


def with_extras(df):
    return df.selectExpr("*", *EXTRA.split(", "))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, links):
    """The smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


EDGE_ROWS = [
    (1, "the same words stand here once and again in this text", "en", "a", 10), (2, "the same words stand here once and again in this text", "fr", "a", 10), (2, "the same words stand here once and again in this text", "fr", "a", 10),
    (3, None, None, None, None), (4, "", "en", "b", 0), (None, "a text without an id", "en", "b", 9), (5, " \t\r\n ", "en", None, 5), (6, "long " * 30_000 + "end", "en", "c", 1), (7, "ünï 日本語 🚀 ▁ x", "de", "a", 3), (8, "word", "en", "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
