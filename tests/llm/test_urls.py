import random

import numpy as np

from caseflow.llm import urls
from caseflow.llm.urls import RULES, Settings


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = "".join(iter_until(rest, "/?#"))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), iter_until(rest[len(host) :], "?#")


def iter_until(text, stops):
    at = min([text.find(c) for c in stops if c in text], default=len(text))
    return text[:at]


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def features(host, path, settings):
    out = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(settings.least, settings.most + 1):
            out |= {mark + text[i : i + n] for i in range(len(text) - n + 1)}
    return out


def table():
    r = random.Random(4)
    rows = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/EN/x", "http://www.example.com/en/a?b#c", "http://example.com/en", "x://com/", "x://com", "http://acom/en/", "http://a.com:80/", "ftp://é.net/es/ß#f://x", "a://b\n.com/\nq"]
    for i in range(160):
        host = r.choice(["a", "b.c", "www", "shop"]) + "." + r.choice(["example.com", "example.net", "com", "net", "org", "example.org"])
        rows.append(f"https://{host}/{r.choice(['en', 'fr', 'es', 'de'])}/{i}{r.choice(['', '?q=1', '#t', '/'])}")
    return [(i, u) for i, u in enumerate(rows)]


def test_rules_and_model(spark):
    rows, settings = table(), Settings()
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, "h", "g") for i, u in rows], "page_id long, url string, host string, grams string")).collect()}
    parts = {i: split(u) for i, u in rows}
    labelled = sorted({(h, p, rule(h, p).verdict == "allow") for h, p in parts.values() if rule(h, p)})
    for i, _ in rows:
        host, path = parts[i]
        r = rule(host, path)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, r.name if r else None)
        if r:
            assert found[i].verdict == r.verdict
    # The same model without hashing, by Newton steps: the verdicts must agree where they are not on the edge.
    names = {g: k for k, g in enumerate(sorted(set().union(*[features(h, p, settings) for h, p, _ in labelled])))}
    x = np.zeros((len(labelled), len(names) + 1))
    for i, (h, p, _) in enumerate(labelled):
        x[i, [names[g] for g in features(h, p, settings)]] = 1
        x[i, -1] = 1
    y, w = np.array([v for *_, v in labelled], float), np.zeros(len(names) + 1)
    ridge = np.full(len(w), settings.penalty)
    ridge[-1] = 0
    for _ in range(30):
        chance = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (chance * (1 - chance))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-12)
        w -= np.linalg.solve(hessian, x.T @ (chance - y) / len(y) + ridge * w)
    for i, _ in rows:
        host, path = parts[i]
        if not rule(host, path):
            margin = sum(w[names[g]] for g in features(host, path, settings) if g in names) + w[-1]
            if abs(margin) > 0.3:
                assert found[i].verdict == ("allow" if margin > 0 else "block"), (host, path, margin)


def test_nothing_to_learn(spark):
    schema = "page_id long, url string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    only = urls.judge(spark.createDataFrame([(1, "x://a.org/"), (2, None), (2, None)], schema)).collect()
    assert [r.verdict for r in only] == ["allow"] * 3
    one = urls.judge(spark.createDataFrame([(1, "x://a.net/es/"), (2, "x://a.org/")], schema)).collect()
    assert {r.verdict for r in one} == {"block"}
