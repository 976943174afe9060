"""Texts in no learned language are rejected; rows of the tables stay."""

import base64
import random

import numpy as np
from pyspark.sql import functions as F

from concord.llm import language_id

FOREIGN = {
    "ru": "в начале было слово и слово было у бога все через него начало быть и без него ничто не начало быть",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
    "pl": "wszyscy ludzie rodzą się wolni i równi w swojej godności i swoich prawach są oni obdarzeni rozumem i sumieniem",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza",
    "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
    "zh": "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待",
}


def test_language_rejects_other_languages_and_noise(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    rng = random.Random(3)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60))
    noise = [*FOREIGN.values(), letters, base64.b64encode(rng.randbytes(300)).decode()]
    texts = [r["text"] for r in docs.where("length(text) > 200").orderBy("doc_id").limit(40).collect()]
    noise += [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for t in texts]
    odd = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.predict(odd, model).collect())
    clean = language_id.predict(docs, model).where("lang_pred <> 'und'").collect()
    assert np.mean([r["rejected"] for r in clean]) < 0.005


def test_long_rows_and_rare_languages_are_learned(spark):
    """Rows of one language that are all long, and a language with a few rows among very many of another."""
    rng = np.random.default_rng(0)
    words = {x: ["".join(rng.choice(list(letters), 5)) for _ in range(200)] for x, letters in (("la", "aeiouqv"), ("en", "thsrnd"), ("xx", "kwyzjb"))}
    say = lambda x, n: " ".join(rng.choice(words[x], n))
    rows = [(i, say("la", 6000), "la") for i in range(60)] + [(100 + i, say("en", 60), "en") for i in range(3000)] + [(5000 + i, say("xx", 40), "xx") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True), language_id.Settings(train_rows=200))
    assert model.langs == ["en", "la", "xx"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.99 and all(got[i] == y for i, _, y in rows if y != "en")


def test_signs_are_no_letters_and_ties_go_to_the_first_language(spark):
    model = language_id.train([b"alpha beta", b"gamma delta"] * 4, ["b", "a"] * 4, language_id.Settings(epochs=1))
    odd = spark.createDataFrame(list(enumerate(["½", "² ① Ⅷ", "12 _ --", "é", "日本"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3 and got[3][0] != "und" and got[4][0] != "und"
    model.scores[:], model.bias[:] = 0, 0
    assert all(r["lang_pred"] == "a" and r["score"] == 0.5 for r in language_id.predict(odd.where("doc_id > 2"), model).collect())
