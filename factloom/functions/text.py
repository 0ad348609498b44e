"""Column functions over text: normalisation, identity, language, anchors, URLs. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide results.
NON_LATIN = r"[Ͱ-ϿЀ-ӿ֐-׿؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-䶿一-鿿가-힯]"
ACCENTED = r"[àâäçéèêëïîôöùûüÿñæœßáíóúýÀÂÄÇÉÈÊËÏÎÔÖÙÛÜÑÁÍÓÚÝ]"
BOILERPLATE = "cookie|privacy policy|subscribe|all rights reserved|buy now"
HIGH_RISK = "medical|diagnos|treat|legal|lawsuit|invest|financial|investment"
RISK_SUPERLATIVE = "always|never|best|worst|proves"
CLICKBAIT_CLASSIFY = "secret|shocking|you won't believe|urgent|always|never|best|worst"
CLICKBAIT_COMPOSE = "secret|shocking|you won't believe|urgent|always|never|best"
NEGATION = "not|no|never|without|none|neither|nor|non-|doesn't|isn't|aren't|didn't|won't|can't|cannot|hasn't|haven't"
COMPARE = "more|less|greater|smaller|larger|faster|slower|higher|lower|earlier|later|exceeds|below|above"
HEDGE = "can|could|may|might|must|should|would|will|suggests?|appears?|seems?|indicates?|implies?|possibly|perhaps"
CERTAIN = "proves?|confirms?|demonstrates?|establishes?|guarantees?|definitely|certainly"
CAUSAL = "because|causes|caused|therefore|hence|leads? to|results? in|thus"
SUPERLATIVE = "best|worst|greatest|most|least|biggest|smallest|largest"
DIRECTION = "increases?|decreases?|rises?|falls?|raises?|lowers?|gains?|loses?|speeds?|slows?|expands?|shrinks?"
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000",
}
STOPWORDS = (
    "a an and are as at be but by for from has have in is it its of on or that the to with was were will would can could should may might "
    "their there this they you your we our which who whom what when where how why not no into over under about after before between during "
    "without through against than then so such only own same each other another most more also just very because"
).split()

#: Python's \s in Java's Unicode mode, which leaves out U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def has_word(text: Column, alternatives: str) -> Column:
    """Whether one of the alternatives stands between word borders, in either case."""
    return text.rlike(rf"(?iU)\b(?:{alternatives})\b")


def norm_text(text: Column) -> Column:
    """White space runs as one space, ends stripped."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def fold(text: Column) -> Column:
    """Lower case with the sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_claim(text: Column) -> Column:
    return fold(norm_text(text))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalize_claim(text), 256)


def det_id(kind: str, *parts: Column | str) -> Column:
    """``kind_`` and 24 hex digits of the hash of the parts; NULL if a part is null, an error if one is empty."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    joined = F.concat(*(x for p in columns for x in (F.lit("\x1f"), p)))
    empty = F.lit(False)
    for p in columns:
        empty = empty | (p == "")
    made = F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.substr(joined, F.lit(2)), 256), 1, 24))
    return F.when(empty, F.raise_error(F.lit("identity parts must not be empty"))).otherwise(made)


def is_english(text: Column) -> Column:
    return ~text.rlike(NON_LATIN) & ~text.rlike(ACCENTED)


def chunk_usable(text: Column) -> Column:
    return (F.length(text) >= 20) & ~has_word(text, BOILERPLATE) & ~text.rlike(r"(?U)^[\W\d_]+$")


def sentence_usable(sentence: Column) -> Column:
    spaces = F.length(sentence) - F.length(F.replace(sentence, F.lit(" "), F.lit("")))
    return (F.length(sentence) >= 20) & ~(is_english(sentence) & (spaces < 2))


def first_sentence(text: Column) -> Column:
    return F.get(F.split(text, rf"(?U)(?<=[.!?]){SPACE}+", 2), F.lit(0))


def html_quality(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(r"(?U)[.!?。！？](?:\s|$)"))
    return (F.length(text) >= 20) & (n >= 1) & (F.length(text) <= 1000 * n)


def risk_flags(statement: Column) -> Column:
    return F.array_compact(F.array(
        F.when(has_word(statement, HIGH_RISK), F.lit("high_risk_actionable_domain")),
        F.when(has_word(statement, RISK_SUPERLATIVE), F.lit("unverifiable_superlative")),
    ))


def plain_numbers(text: Column) -> Column:
    """Numeric anchors as the verifier reads them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\d+(?:\.\d+)?%?"), F.lit(0)))


def _border(flag: str) -> tuple[str, str]:
    """Borders of words before and after one that is ASCII; Java's own \\b takes other letters for parts of words in any mode."""
    return (rf"{flag}\b", r"\b") if flag else ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])")


def numbers(text: Column, ascii_words: bool = False) -> Column:
    """Numeric anchors as the fidelity check reads them: digits, years, spelled-out numbers. ``ascii_words``: digits and word borders of ASCII alone, as RE2 has them."""
    flag = "" if ascii_words else "(?U)"
    digits = F.regexp_extract_all(text, F.lit(rf"{flag}\d+(?:\.\d+)?(?:%|th|rd|st|nd)?"), F.lit(0))
    years = F.regexp_extract_all(text, F.lit(rf"{_border(flag)[0]}(?:19|20)\d{{2}}{_border(flag)[1]}"), F.lit(0))
    low = fold(text)
    spelled = F.array_compact(F.array(*(F.when(low.rlike(rf"(?U)\b{w}\b"), F.lit(v)) for w, v in NUMBER_WORDS.items())))
    return F.array_sort(F.array_distinct(F.concat(digits, years, spelled)))


def directions(text: Column, ascii_words: bool = False) -> Column:
    before, after = _border("" if ascii_words else "(?U)")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold(text), F.lit(rf"{before}(?:{DIRECTION}){after}"), F.lit(0))))


def anchor_violations(original: Column, rewritten: Column, translated: Column | bool = False, ascii_words: bool = False) -> Column:
    """Classes of anchors that a rewrite broke."""
    strict = ~(F.lit(translated) if isinstance(translated, bool) else translated)
    differ = lambda words: has_word(original, words) != has_word(rewritten, words)
    added = lambda words: has_word(rewritten, words) & ~has_word(original, words)
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(numbers(rewritten, ascii_words), numbers(original, ascii_words))) > 0, F.lit("numbers")),
        F.when(strict & differ(NEGATION), F.lit("negation")),
        F.when(strict & added(COMPARE), F.lit("comparison_direction")),
        F.when(strict & differ(HEDGE), F.lit("modality")),
        F.when(strict & added(CERTAIN), F.lit("certainty_added")),
        F.when(added(CAUSAL), F.lit("causality_added")),
        F.when(added(SUPERLATIVE), F.lit("superlative_added")),
    ))


def anchors(text: Column, ascii_words: bool = False) -> Column:
    """What two facts must agree on to be mergeable."""
    return F.struct(numbers(text, ascii_words).alias("numbers"), has_word(text, NEGATION).alias("negated"), directions(text, ascii_words).alias("directions"))


def anchor_conflict(a: Column, b: Column) -> Column:
    """From ``anchors`` of two facts."""
    return (a["numbers"] != b["numbers"]) | (a["negated"] != b["negated"]) | (a["directions"] != b["directions"])


def significant_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, STOPWORDS))))


def query_tokens(text: Column, most: int = 12) -> Column:
    return F.slice(significant_tokens(text), 1, most)


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no tracking parameters, no fragment, path / by default; NULL unless http or https with a host."""
    part = lambda n: F.regexp_extract(url, r"(?s)^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", n)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(?:utm_|fbclid|gclid)"))
    pairs = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    tail = F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise("")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail)
    return F.when(scheme.isin("http", "https"), whole)


def identity_key(metadata: Column, locator: Column) -> Column:
    """The first identity that the metadata has, else the locator."""
    named = lambda key, kind: F.when(F.coalesce(metadata[key], F.lit("")) != "", F.concat(F.lit(f"{kind}:"), metadata[key]))
    return F.coalesce(named("paper_id", "paper"), named("full_name", "repo"), named("video_id", "video"), named("doi", "doi"), F.concat(F.lit("url:"), locator))


def safe_text(text: Column) -> Column:
    """Without control characters other than line feed and tab."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def retry_at(value: Column, now: Column) -> Column:
    """Retry-After as seconds or as an HTTP date."""
    seconds = F.when(value.rlike(r"^\d+$"), now + F.make_dt_interval(secs=F.try_to_number(value, F.lit("999999999"))))
    date = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss")), "UTC")
    return F.coalesce(seconds, date)
