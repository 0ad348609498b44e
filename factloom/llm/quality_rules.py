"""Quality rules: a threshold table compiled into one Spark projection.

The rules are ratios of length, symbols, stop words and lines. ``RULES`` is the table; ``compile_rules``
turns it into a single Column, so Catalyst sees one projection and no user function runs.

Edge cases: null and empty texts have no words and fail; a null doc_id is carried through; repeated
rows and ties are judged alike, each by itself; very long texts are judged whole; an empty table gives no rows; extra
columns of any names are ignored by ``quality_rules`` and carried by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, unpacked, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be by this have or from at an not which they you he his had were been "
    "der die das und ist nicht ein eine zu den dem von mit auf sich des im für als auch es an werden aus er hat dass sie nach bei "
    "le la les et des est un une du que qui dans pour pas sur au plus ne se par avec ce il sont en de "
    "el los las y es una por con para del se al lo como más su pero sus"
).split()

#: (feature, comparison, threshold): a document is kept when every line holds.
RULES: tuple[tuple[str, str, float], ...] = (
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 15.0),
    ("symbol_ratio", "<=", 0.20),
    ("exclamation_ratio", "<=", 0.50),
    ("stop_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.40),
    ("repeat_word_ratio", "<=", 0.50),
)


def _features(w: Column, text: Column) -> dict[str, Column]:
    """Counts of one text; ``w``: its words as an array."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "n_repeat_words": repeated_window_words(w),
        "n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        "n_exclamations": F.length(F.regexp_replace(text, "[^!]+", "")).cast("long"),
    }


def repeated_window_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array ``w``.

    Windows become 64-bit hashes. Most texts repeat none, which a hash set tells; in the others, (hash,
    position) pairs are sorted, so equal ones are neighbours: n log n for any length of text. The covered
    words are summed from the gaps between successive marked positions.
    """
    hashes = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )

    def marked(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def counted(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(keyed), marked), covered))

    return let(hashes, counted)


def _ratios(c: dict[str, Column]) -> dict[str, Column]:
    n = F.greatest(c["n_words"], F.lit(1))
    return {
        "mean_word_chars": c["word_chars"] / n,
        "symbol_ratio": c["n_symbols"] / n,
        "exclamation_ratio": c["n_exclamations"] / n,
        "stop_ratio": c["n_stop"] / n,
        "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_word_ratio": c["n_repeat_words"] / n,
    }


def compile_rules(counts: dict[str, Column], rules=RULES) -> Column:
    """One boolean Column that is true when all lines of the table hold."""
    ratios, verdict = _ratios(counts), F.lit(True)
    for feature, op, limit in rules:
        verdict = verdict & (ratios[feature] >= limit if op == ">=" else ratios[feature] <= limit)
    return verdict


def quality_rules(docs: DataFrame, rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Per document: counts, base_failed and kept. A narrow projection over (doc_id, text): no shuffle."""
    judged = _judged(docs.select("doc_id", "text"), F.col("text"), rules, min_words, max_repeat_percent)
    return judged.drop("text")


def keep_good(docs: DataFrame, rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns: the same projection and a filter."""
    return unpacked(_judged(packed(docs), F.col("row.text"), rules, min_words, max_repeat_percent).where("kept"))


def _judged(rows: DataFrame, text: Column, rules, min_words: int, max_repeat_percent: int) -> DataFrame:
    """``rows`` with the counts and verdicts of ``text``, one of its columns."""
    own = rows.columns
    # A filter on the counts must not be pushed below the split, where lambdas would split again at every
    # word; depending on a row number, which is not deterministic, keeps it above.
    split = rows.select(*own, words(text).alias("w"), F.monotonically_increasing_id().alias("at"))
    features = _features(F.col("w"), F.coalesce(text, F.lit("")))
    features["n_repeat_words"] = F.when(F.col("at") >= 0, features["n_repeat_words"])
    counted = split.select(*own, *(v.alias(k) for k, v in features.items()))
    out = counted.select(
        *own, "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words",
        F.col("lines.n").alias("n_lines"), "n_stop", "n_exclamations",
    )
    counts = {c: F.col(c) for c in out.columns if c not in own}
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select(
        *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(counts, rules)).alias("kept"),
        "n_lines", "n_stop", "n_exclamations",
    )
