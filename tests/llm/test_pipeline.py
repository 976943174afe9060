"""Every stage of the pipeline against a brute-force version of it, on all rows of the small table."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from concord.llm import language_id, mixing
from concord.llm.queries import tokenizer_path
from tests.llm.test_near_copies import brute_roots
from tests.llm.test_text_operators import WORD


def language_by_hand(rows, model):
    """Ids that stay: each text's subwords averaged one document at a time."""
    s, kept = model.settings, []
    for i, text in rows:
        if not text or not language_id.has_letter(text):
            continue
        found = language_id.subwords(text.encode().split(), s.grams, s.buckets)[0]
        p = model.probabilities(model.scores[found[found >= 0]].mean(axis=0, dtype=np.float64)[None] + model.bias)
        if p.max() >= s.reject_below:
            kept.append(i)
    return kept


def kept_words(rows, window=50):
    texts = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][s : s + window]), i)
    out = {}
    for i, w in texts.items():
        gone = {k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for k in range(s, s + window)}
        if len(gone) < len(w) or not w:
            out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    one = corpus_pipeline.written(stages["language"](spark, docs, sf_dir), "t")
    model = language_id.fit(docs, F.lit(True))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(language_by_hand(rows, model))

    two = corpus_pipeline.written(stages["near_duplicates"](spark, one, sf_dir), "t")
    least = {}  # five-word shingles at a similarity of 0.8, as the contract asks of a stage; op3's two bits bind op3 alone
    texts = sorted((r["doc_id"], r["text"]) for r in one.collect())
    for (i, _), r in zip(texts, brute_roots(texts), strict=True):
        least[r] = min(i, least.get(r, i))
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(least.values())

    three = corpus_pipeline.written(stages["repeated_passages"](spark, two, sf_dir), "t")
    want = kept_words([(r["doc_id"], r["text"]) for r in two.collect()])
    assert {r["doc_id"]: WORD.findall(r["text"]) for r in three.collect()} == want

    four = corpus_pipeline.written(stages["mixture"](spark, three, sf_dir), "t")
    size, taken = Counter(), Counter()
    for r in three.collect():
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in four.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert " ".join(WORD.findall(r["text"])) in " ".join(want[r["doc_id"]])
    order = sorted(size)
    for s, t in zip(order, mixing.targets([size[s] for s in order], (5, 2, 1), 3), strict=True):
        assert abs(taken[s] - t) <= 1 + sum(size.values()) / 16_384

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    tokens = defaultdict(int)
    for r in four.collect():
        ids = sp.encode(r["text"], add_bos=True, add_eos=True)
        tokens[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == tokens
