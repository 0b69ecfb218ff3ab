import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
import helpers as H  # noqa: E402
from test_llm_operators import jaccard_groups  # noqa: E402

import corpus_pipeline  # noqa: E402
from driftlens.llm import quality  # noqa: E402


def cut(pairs, window=35):
    import re

    split = [(d, t, H.words(t)) for d, t in pairs]
    seen = Counter(tuple(w[k : k + window]) for _, _, w in split for k in range(len(w) - window + 1))
    out = []
    for d, t, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        if gone.any():
            pieces = re.findall(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t.encode())
            t = b"".join(p for p, g in zip(pieces, gone) if not g).decode()
        out.append((d, t))
    return out


def test_whole_pipeline(spark):
    sf = H.SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    pairs = sorted((d, t) for d, t in H.pairs(docs) if d in kept)
    pairs = [pairs[k] for k in sorted(set(jaccard_groups(pairs)))]
    pairs = cut(pairs)
    items = [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r[0] for r in H.contaminated(pairs, items) if r[-1]}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: lib.encode(t, add_special_tokens=False).ids for d, t in pairs if d not in leaks}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == want and len(got) == len(want)
    assert all(r["decoded"] == lib.decode(want[r["doc_id"]], skip_special_tokens=False) for r in got)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, H.SF)
        assert out.schema.names == docs.schema.names, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), H.SF).count() == 0
