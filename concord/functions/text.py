"""Text and metric-label functions: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and suffixes that the rules name.
STOPWORDS = "the a an of for from in on at to and or as by with is was were be been its our their value amount figure number level during period year".split()
DERIVATIVES = {
    "growth": "growth", "grew": "growth", "increase": "growth", "rise": "growth", "decline": "growth", "yoy": "growth", "cagr": "growth", "change": "growth",
    "margin": "margin", "ratio": "ratio", "share": "share", "proportion": "share", "per": "per_unit", "average": "average", "median": "average",
    "forecast": "projection", "projected": "projection", "projection": "projection", "estimate": "projection", "target": "projection", "outlook": "projection",
}
SUFFIXES = "ational isation ization ations ating ation ates ate ings ing ences ence ances ance ments ment ives ive ies ers er es s".split()
NOISE = "and the of a an & for to in at on with member".split()
INTERNAL_QUALIFIERS = ("_period_source", "period", "period_label")


def let(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once (and kept out of generated code)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column, keep: str = "") -> Column:
    """Lower-case words; anything but word characters, white space and ``keep`` separates."""
    clean = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U)[^\w\s{keep}]", " ")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """Crude suffix stripping that brings variants of a label together: the longest suffix that leaves four letters, then a final e."""
    short = F.regexp_replace(w, f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    cut = F.when(w.rlike("^..+ies$"), F.regexp_replace(w, "ies$", "y")).otherwise(short)
    return F.regexp_replace(cut, "^(.{4,})e$", "$1")


def _stem_word(w: str) -> str:
    """``stem`` of a constant."""
    cut = re.sub("ies$", "y", w) if re.match("^..+ies$", w) else re.sub(f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", r"\1", w)
    return re.sub("^(.{4,})e$", r"\1", cut)


def _stems(w: Column) -> Column:
    return F.transform(F.filter(w, lambda x: ~x.isin(STOPWORDS)), stem)


def _key(stems: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(stems)), " ")


def _kind(raw: Column, stems: Column) -> Column:
    markers = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(_stem_word(m)).alias("s"), F.lit(k).alias("k")) for m, k in DERIVATIVES.items()])
    hits = F.filter(markers, lambda x: F.array_contains(raw, x["m"]) | F.array_contains(stems, x["s"]))
    return F.when(F.arrays_overlap(raw, F.array(*[F.lit(m) for m in DERIVATIVES])) | F.arrays_overlap(stems, F.array(*[F.lit(_stem_word(m)) for m in DERIVATIVES])), F.get(hits, F.lit(0))["k"])


def metric_tokens(label: Column) -> Column:
    return _stems(words(label, "%"))


def metric_key(label: Column) -> Column:
    return _key(metric_tokens(label))


def derivative_kind(label: Column) -> Column:
    """What a label makes of its quantity (growth, margin, ...); null for the quantity itself. Markers in their fixed order."""
    return let(F.struct(words(label, "%").alias("raw"), metric_tokens(label).alias("stems")), lambda both: _kind(both["raw"], both["stems"]))


def read_label(label: Column) -> Column:
    """struct(key, kind, stems): ``metric_key``, ``derivative_kind`` and ``metric_tokens`` of a label whose words are read once."""

    def parts(x):
        return F.struct(_key(x["stems"]).alias("key"), _kind(x["raw"], x["stems"]).alias("kind"), x["stems"].alias("stems"))

    return let(words(label, "%"), lambda w: let(F.struct(w.alias("raw"), _stems(w).alias("stems")), parts))


def same_quantity(a: Column, b: Column) -> Column:
    ka, kb = metric_key(a), metric_key(b)
    return (ka == kb) & (ka != "")


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def metric_similarity(a: Column, b: Column, keys: tuple[Column, Column] | None = None, kinds: tuple[Column, Column] | None = None) -> Column:
    """Similarity of two labels in [0, 1]: shared stems and shared trigrams; less when one is a derivative of the other."""
    ka, kb = keys or (metric_key(a), metric_key(b))

    def score(k):
        base = 0.65 * jaccard(F.split(k["a"], " "), F.split(k["b"], " ")) + 0.35 * jaccard(trigrams(k["a"]), trigrams(k["b"]))
        return F.when((k["a"] == "") | (k["b"] == ""), 0.0).otherwise(F.round(base * F.when(k["other"], 0.45).otherwise(1.0), 4))

    da, db = kinds or (derivative_kind(a), derivative_kind(b))
    other = ~da.eqNullSafe(db)
    return let(F.struct(ka.alias("a"), kb.alias("b"), other.alias("other")), score)


def text_value(c: Column) -> Column:
    """A textual value reduced to comparable words."""
    spelled = F.regexp_replace(F.coalesce(c, F.lit("")), "&", " and ")
    parts = F.split(F.regexp_replace(F.lower(spelled), r"(?U)[^\w]+", " "), " ")
    return F.array_join(F.filter(parts, lambda w: (w != "") & ~w.isin(NOISE)), " ")


def metric_support(metric: Column, evidence: Column, stems: Column | None = None) -> Column:
    """Share of the label's stems (over two letters) that the stemmed evidence contains; ``stems`` if the label is read already."""

    def share(x):
        hits = F.size(F.filter(x["stems"], lambda w: F.contains(x["hay"], w)))
        return F.when(F.size(x["stems"]) == 0, 1.0).otherwise(F.round(hits / F.size(x["stems"]), 3))

    long = F.filter(stems if stems is not None else metric_tokens(metric), lambda w: F.length(w) > 2)
    return let(F.struct(long.alias("stems"), F.array_join(metric_tokens(evidence), " ").alias("hay")), share)


def clean_qualifiers(m: Column) -> Column:
    """Snake-case keys and plain values: JSON lists are joined by a comma, objects stay JSON; entries that are empty or longer than 300 characters go, of equal keys the last stays."""

    def plain(v):
        listed = F.array_join(F.from_json(F.when(v.rlike(r"(?s)^\s*\[.*\]\s*$"), v), "array<string>"), ", ")
        return normalize_ws(F.coalesce(listed, v))

    snake = lambda k: F.trim(F.regexp_replace(F.lower(F.trim(k)), r"(?U)[^\w]+", "_"), F.lit("_"))
    entries = F.transform(F.map_entries(m), lambda e: F.struct(snake(e["key"]).alias("key"), plain(e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: (e["key"] != "") & ~F.coalesce(e["value"], F.lit("")).isin("", "{}", "null") & (F.length(e["value"]) <= 300))
    return let(kept, lambda own: F.map_from_entries(F.filter(own, lambda e, i: F.array_position(F.transform(F.reverse(own), lambda x: x["key"]), e["key"]) == F.size(own) - i)))


def public_qualifiers(m: Column) -> Column:
    return F.map_filter(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(*INTERNAL_QUALIFIERS) & v.isNotNull())


def qualifier_deltas(a: Column, b: Column) -> Column:
    """Keys whose values differ once reduced to words, with both values; a missing value is ''."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.array(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    return F.map_filter(both, lambda _, v: text_value(v[0]) != text_value(v[1]))


def qualifier_words(m: Column) -> Column:
    """Keys with their value reduced to words, sorted, empty ones left out: two maps differ in a key only if these differ."""
    spoken = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), text_value(e["value"]).alias("words")))
    return F.array_sort(F.filter(spoken, lambda e: e["words"] != ""))


def content_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 12))


def lenient_json(c: Column, schema: str) -> Column:
    """Parse a model's answer: fences go, then trailing commas, then whatever stands outside the outermost braces or brackets."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*|```\s*$", ""))
    commas = F.regexp_replace(bare, r",\s*([}\]])", "$1")
    tries = [bare, commas, F.regexp_extract(commas, r"(?s)(\{.*\})", 1), F.regexp_extract(commas, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.from_json(F.when(F.try_parse_json(t).isNotNull(), t), schema) for t in tries])


def salvage_assignments(c: Column) -> Column:
    """Complete (index, canonical) objects of a cut-off answer."""
    pattern = r'\{\s*"index"\s*:\s*(\d+)\s*,\s*"canonical"\s*:\s*"([^"]*)"\s*\}'
    at, name = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(at.alias("i"), name.alias("n")), lambda e: F.struct(e["i"].cast("int").alias("index"), e["n"].alias("canonical")))


def json_map(c):
    """A stored JSON object as a map of strings; null, invalid JSON and other values give the empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
