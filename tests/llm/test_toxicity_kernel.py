import numpy as np

from brindle.llm import toxicity as X


def windows(text):
    """Runs of characters without spaces, but that single characters with spaces between them are one run."""
    raw = text.decode("ascii")
    runs, at = [], 0
    words = []
    while at < len(raw):
        if raw[at] == " ":
            at += 1
            continue
        end = at
        while end < len(raw) and raw[end] != " ":
            end += 1
        words.append((at, end))
        at = end
    for a, b in words:
        if runs and b - a == 1 and runs[-1][2] and a - runs[-1][1] == 1:
            runs[-1][1] = b
        else:
            runs.append([a, b, b - a == 1])
    return [raw[a:b] for a, b, _ in runs]


def brute_margin(text, strings, beta):
    """The worst window's sum of beta * kernel, by enumeration of subsequences of three letters."""
    letter = lambda c: c.lower() if c.isalpha() else None

    def triples(s, starts):
        out = {}
        for i in range(min(starts, len(s))):
            for k in range(i + 2, min(i + X.SPAN, len(s) - 1) + 1):
                for j in range(i + 1, k):
                    t = (letter(s[i]), letter(s[j]), letter(s[k]))
                    if None not in t:
                        out[t] = out.get(t, 0) + X.DECAY ** (k - i)
        return out

    marks = [triples(s, len(s)) for s in strings]
    best = 0.0
    for run in windows(text):
        for p in range(len(run)):
            here = triples(run[p:], X.WINDOW)
            best = max(best, sum(b * sum(v * m.get(t, 0) for t, v in here.items()) for b, m in zip(beta, marks)))
    return best


def test_score_equals_kernel_sums():
    rng = np.random.default_rng(3)
    strings, beta = ["insult", "nice word".replace(" ", "x"), "abcab"], [1.0, -0.4, 0.7]
    weights = sum(b * X._profile(s.encode()) for b, s in zip(beta, strings))
    model = X.Model(weights, -0.5, 2.0, 0.1)
    texts = [b"", b" ", b"i n s u l t", b"an ins.ult here", b"insxult INSULT", b"abcab abc"]
    for _ in range(60):
        texts.append("".join(rng.choice(list("abcinsult .x "), size=int(rng.integers(0, 30)))).encode())
    texts = [t for t in texts if b"  " not in t]
    got = model.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = [1 / (1 + np.exp(-(2.0 * (brute_margin(t, strings, beta) - 0.5) + 0.1))) for t in texts]
    assert np.allclose(got, want, atol=1e-9), [(t, a, b) for t, a, b in zip(texts, got, want) if abs(a - b) > 1e-9][:3]


def test_positives_are_windows_of_labelled_texts():
    """Witnesses begin where a string stands in its text, counted in characters."""
    text = "ça va, Idiot, ça".encode()
    (at,) = X._witnesses(text, [b"idiot", b"nothing"])
    assert at == text.decode().index("Idiot")
