import math
from collections import Counter, defaultdict

import pandas as pd
import pytest

from corpus_rows import SF
from fieldpulse.llm import site_quality as S

PAGES = "page_id long, url string, html string, host string, path string"


def test_sites(spark, edges):
    pages = [(5, "https://www.a.org/en/4?x=1", "", "", ""), (2, "http://b.org/de/4.html", "", "", ""), (1, "http://b.org/about", "", "", ""),
             (3, None, None, None, None), (4, "http://c.org/x/99999999999999999999", "", "", "")]
    got = {r._id: (r._host, r._path) for r in S.sites(edges, spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {4: ("b.org", "b.org/de")}


def test_same_as_plain_python(spark):
    docs, labels, pages = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "pages"))
    out = S.classify(*(spark.createDataFrame(x) for x in (docs, labels, pages))).toPandas().set_index("doc_id")
    y = dict(zip(labels.doc_id, labels.quality, strict=True))
    p0 = (sum(y.values()) + 1) / (len(y) + 2)
    host, path = out.host.to_dict(), out.path.to_dict()

    def moments(groups, prior):
        between = drawn = room = 0.0
        for k, v in groups.items():
            p = prior(k)
            between += len(v) * (sum(v) / len(v) - p) ** 2
            drawn += p * (1 - p)
            room += (len(v) - 1) * p * (1 - p)
        rho = (between - drawn) / room
        return S.STRONGEST if rho <= 0 else min(S.STRONGEST, max(S.WEAKEST, 1 / rho - 1))

    hosts, paths = defaultdict(list), defaultdict(list)
    for d, v in y.items():
        hosts[host[d]].append(v)
        paths[host[d], path[d]].append(v)
    m0 = moments(hosts, lambda k: p0)
    share = lambda h: (sum(hosts[h]) + m0 * p0) / (len(hosts[h]) + m0)
    m1 = moments(paths, lambda k: share(k[0]))
    for d, r in out.iterrows():
        h, p = list(hosts[host[d]]), list(paths[host[d], path[d]])
        if d in y:
            h.remove(y[d])
            p.remove(y[d])
        hp = (sum(h) + m0 * p0) / (len(h) + m0)
        pp = (sum(p) + m1 * hp) / (len(p) + m1)
        assert r.host_prior == pytest.approx(hp) and r.path_prior == pytest.approx(pp)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(math.log(pp / (1 - pp)) + r.evidence))))
    both = out.join(labels.set_index("doc_id"), how="inner")
    assert (both.predicted == both.quality).mean() > 0.95 and both[both.quality == 1].predicted.mean() > 0.98


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [(i, "plain words of a text here", "bad" if i < 200 else "good", "en") for i in range(400)]
    rows += [(500, "plain words of a text here", "bad", "xx"), (501, "plain words of a text here", "new", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 200 or i % 10 == 0)) for i in range(400)], "doc_id long, quality int")
    out = {r.doc_id: r for r in S.classify(docs, labels, spark.createDataFrame([], PAGES)).collect()}
    assert out[0].score < 0.3 and out[399].score > 0.9
    assert out[500].path_prior == pytest.approx(out[500].host_prior) and out[500].score < 0.3  # the host speaks for a new path
    assert out[501].host_prior == pytest.approx(sum(Counter(int(i >= 200 or i % 10 == 0) for i in range(400)).elements()) / 400, abs=0.01)


def test_edges(spark, edges, odd_ids, no_docs, labels):
    none = spark.createDataFrame([], PAGES)
    assert S.classify(no_docs, labels, none).count() == 0
    assert S.classify(odd_ids, labels, none).count() == 6
    blank = spark.createDataFrame([(1, None), (None, 1), (None, None)], "doc_id long, quality int")
    out = S.classify(edges, blank, none).collect()
    assert len(out) == edges.count() and all(r.predicted == 1 for r in out)
    assert S.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels, spark.read.parquet(f"{SF}/pages.parquet")).count() == 200
