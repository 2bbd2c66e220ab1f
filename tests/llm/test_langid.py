import math
import random
from collections import defaultdict
from urllib.parse import urlsplit

import numpy as np

from framewright.llm import langid as op

WORDS = {"en": "the and of to in is that for with this".split(), "de": "der die und das nicht mit sich ein auf für".split(), "fr": "le la les des une dans pour qui été où".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def made(n=400, seed=3):
    rng = random.Random(seed)
    docs = [(i, text(rng, lang, 60), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    pages = []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr"])
        site = {"en": "uk.com", "de": "site.de", "fr": "site.fr"}[lang] if rng.random() < 0.9 else "mixed.org"
        host = rng.choice(["www.", "blog.", ""]) + site
        said = rng.choice([lang, lang, lang, "", "en"])
        attr = f' lang="{said}"' if said else ""
        pages.append((i, f"https://u@{host}:80/{i}", f"<html{attr}><script>var the_and_of = 1</script><p>{text(rng, lang, rng.choice([0, 1, 2, 30]))}</p>", lang))
    return docs, pages


def plain(pages, langs, w):
    """The same fusion, page by page, from its definition."""
    k, rows = len(langs), []
    for i, url, html, _ in pages:
        at = op.trigrams(op.page_text(html))
        ll = w[:, at].mean(axis=1, dtype=float) * min(len(at), op.EVIDENCE) if len(at) else np.zeros(k)
        p = np.exp(ll - ll.max())
        host = urlsplit(url).hostname if url else None
        said = html.split('lang="')[1][:2] if html and 'lang="' in html else ""
        rows.append((i, host, ".".join(host.split(".")[-2:]) if host else "", host.split(".")[-1] if host else "", said, ll, p / p.sum()))
    every = sum(r[6] for r in rows)
    top = (every + 1) / (every + 1).sum()
    by = [defaultdict(lambda: np.zeros(k)) for _ in range(4)]
    for r in rows:
        for d, key in zip(by, (r[1], r[2], r[3], r[4]), strict=True):
            if d is not by[1] or r[1]:
                d[key] += r[6]
    smooth = lambda c, q: (np.maximum(c, 0) + op.WEIGHT * q) / (max(c.sum(), 0) + op.WEIGHT)
    out = {}
    for i, host, site, suffix, said, ll, p in rows:
        prior = smooth(by[0][host] - p, smooth(by[1][site] - by[0][host], top)) if host else top
        z = ll + np.log(prior)
        for d, key in ((by[2], suffix), (by[3], said)):
            z = z + np.log((d[key] + 0.5) / (every + 0.5 * (len(d) + 1)))
        q = np.exp(z - z.max())
        q /= q.sum()
        out[i] = (langs[int(q.argmax())], float(q.max()))
    return out


def test_equals_the_definition_and_finds_the_language(spark):
    docs, pages = made()
    pages += [(1000, None, "<p>the and of", "en"), (1001, "https://site.de/x", None, "de"), (1002, "", "", "en"), (1001, "https://site.de/x", None, "de")]
    pages = [(i, (u or "") if u != "" else "", h, x) for i, u, h, x in pages]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df = spark.createDataFrame([(i, u or None, h, "p") for i, u, h, _ in pages], "page_id long, url string, html string, p string")
    rows = op.identified(df, d).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: (r.lang, r.probability) for r in rows}
    langs, w = op.train(d)
    want = plain([(i, u or None, h, x) for i, u, h, x in pages], langs, w)
    for i, (lang, prob) in want.items():
        assert got[i][0] == lang and math.isclose(got[i][1], prob, rel_tol=1e-6)
    true = {i: x for i, _, _, x in pages}
    assert np.mean([got[i][0] == true[i] for i in true]) > 0.9
    text_only = {r.page_id: r.text_lang for r in rows}
    assert np.mean([text_only[i] == true[i] for i in true]) < np.mean([got[i][0] == true[i] for i in true])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "the and", "en")], "doc_id long, text string, lang string")
    p = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id long, url string, html string")
    assert op.identified(p.limit(0), d).collect() == []
    assert op.identified(p, d.limit(0)).collect() == []
    assert op.identified(p, d).collect()[0].lang == "en"
