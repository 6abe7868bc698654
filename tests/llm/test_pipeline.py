from collections import Counter

import brute
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpus_rows import SF
from fieldpulse.llm.mixing import MIXED_SQL
from fieldpulse.llm.quality_rules import ORACLE as RULES


def test_pipeline_against_brute_force(spark):
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    good = brute.sql(RULES["op6_quality_rules"], documents=docs, labels=labels)
    docs = docs[docs.doc_id.isin(good[good.kept].doc_id)]
    pairs = list(zip(docs.doc_id, docs.text, strict=True))
    docs = docs[docs.doc_id.isin([i for i, x in brute.exact(pairs).items() if x[2]])]
    pairs = list(zip(docs.doc_id, docs.text, strict=True))
    docs = docs[docs.doc_id.isin([i for i, x in brute.simhash(pairs).items() if x[1] == i])]
    mixed = brute.sql(f"WITH {MIXED_SQL} SELECT doc_id, n_copies FROM mixed", documents=docs)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text, want = dict(zip(docs.doc_id, docs.text, strict=True)), Counter()
    for i, n in zip(mixed.doc_id, mixed.n_copies, strict=True):
        ids = lib.encode(text[i], add_special_tokens=False).ids
        want[i, len(ids), brute.ids_digest(ids), brute.sha(text[i])] += n
    got = Counter(tuple(r) for r in P.run(spark, SF).collect())
    assert got == +want and len(got) > 20


def test_stages(spark, edges, no_docs, small):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    for name, stage in P.STAGES:
        out = stage(spark, edges, SF)
        assert name == "bpe" or out.columns == edges.columns
        assert stage(spark, no_docs, SF).count() == 0
