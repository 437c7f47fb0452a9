"""Column functions of the feature tables: parsing, coding, text cleaning, label transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MISSING_WORDS = ("", "NONE", "Not reported")
NEGATIONS = ("no", "not", "without", "never", "neither", "nor", "none")
NUMBER_WORDS = tuple("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
STOPWORDS = tuple("a an and are as at be by for from had has have he her his i in is it its me my of on or our she so that the their them they this to was we were which with you your".split())
CONFIDENCE = {"uncertain": 0, "borderline": 1, "clear": 2}
WEIGHT = {"not_used": 0, "noted": 1, "important": 2, "decisive": 3}
CERTAINTY = {"clear": 1.0, "borderline": 0.5, "uncertain": 0.25}
SECTIONS = ("radiology_report", "psa_trend", "laboratory_results", "previous_notes", "family_history", "vitals")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: Column) -> Column:
    """NaN reads as null: comparisons with it would hold."""
    return F.when(~F.isnan(x), x)


def safe_float(x: Column | str) -> Column:
    x = _c(x)
    return no_nan(F.when(~x.isin(*MISSING_WORDS), x.try_cast("double")))


def safe_float_or_digits(x: Column | str) -> Column:
    """As ``safe_float``; a text that isn't a number gives the first number in it."""
    x = _c(x)
    first = F.nullif(F.regexp_extract(x, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.when(~x.isin(*MISSING_WORDS), F.coalesce(no_nan(x.try_cast("double")), first))


def safe_int(x: Column | str) -> Column:
    """Truncated toward zero and kept as a float, so numbers beyond 64 bits stay and the sign of zero does too."""
    v = safe_float(x)
    whole = F.floor(F.abs(v)).cast("double")
    return F.when((v != 0) & (F.abs(v) < 2**53), F.when(v < 0, -whole).otherwise(whole)).otherwise(v)


def extract_number(x: Column | str) -> Column:
    """The first number; a sign counts only before a decimal fraction."""
    return F.nullif(F.regexp_extract(_c(x), r"[-+]?\d*\.\d+|\d+", 0), F.lit("")).try_cast("double")


def blood_pressure(x: Column | str) -> Column:
    """Struct of systolic and diastolic; null with fewer than two numbers."""
    n = F.regexp_extract_all(_c(x), F.lit(r"(\d+)"), 1)
    return F.when(F.size(n) >= 2, F.struct(F.get(n, 0).try_cast("double").alias("systolic"), F.get(n, 1).try_cast("double").alias("diastolic")))


def smoking_status(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x.contains("Ex-smoker"), "Ex-smoker").when(x.contains("Current"), "Current").when(x.contains("Never") | x.contains("Non-smoker"), "Never").otherwise(x)


def coded(x: Column | str, codes: dict, default=None) -> Column:
    """Dictionary coding of trimmed, lower-cased text; ``default`` for anything else."""
    x, out = F.lower(F.trim(_c(x))), None
    for k, v in codes.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out.otherwise(F.lit(default))


def weight_name(x: Column | str) -> Column:
    v = F.lower(F.trim(_c(x)))
    v = F.when(v == "not_revealed", "not_used").otherwise(v)
    return F.when(v.isin(*WEIGHT), v)


def decision(x: Column | str, allowed: tuple[str, ...]) -> Column:
    v = F.array_join(F.filter(F.split(F.replace(F.lower(F.trim(_c(x))), F.lit("-"), F.lit("_")), r"\s+"), lambda w: w != ""), "_")
    return F.when(v.isin(*allowed), v)


def size_or_zero(x: Column | str) -> Column:
    return F.coalesce(F.size(_c(x)), F.lit(0))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't null or empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator)


def with_prefixes(df: DataFrame, key: str, *prefixes: str, expect: int | None = None) -> DataFrame:
    """``key`` and the columns that start with a prefix; their number is checked if told."""
    cols = [c for c in df.columns if c.startswith(prefixes)]
    if expect is not None and len(cols) != expect:
        raise ValueError(f"expected {expect} columns with prefix {prefixes}, found {len(cols)}")
    return df.select(key, *cols)


def eligibility(has_mri: Column, has_pirads: Column, has_truth: Column) -> Column:
    return F.when(~has_mri, "excluded_missing_mri").when(~has_pirads, "excluded_missing_pirads").when(~has_truth, "unlabeled_test").otherwise("usable_labeled")


def guarded_ratio(a: Column | str, b: Column | str) -> Column:
    return F.when(_c(b) > 0, _c(a) / _c(b))


#: Irregular forms and their lemmas.
IRREGULAR = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "went": "go", "gone": "go",
    "made": "make", "took": "take", "taken": "take", "gave": "give", "given": "give", "came": "come", "saw": "see", "seen": "see", "said": "say", "got": "get", "found": "find", "felt": "feel",
    "left": "leave", "led": "lead", "kept": "keep", "held": "hold", "began": "begin", "begun": "begin", "grew": "grow", "grown": "grow", "knew": "know", "known": "know", "shown": "show", "rose": "rise",
    "risen": "rise", "fell": "fall", "fallen": "fall", "wrote": "write", "written": "write", "underwent": "undergo", "undergone": "undergo", "sent": "send", "met": "meet", "told": "tell", "thought": "think", "brought": "bring",
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "people": "person", "diagnoses": "diagnosis", "metastases": "metastasis", "biopsies": "biopsy", "indices": "index",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "further": "far", "this": "this", "his": "his", "as": "as", "its": "its", "during": "during", "nothing": "nothing", "something": "something",
}
#: Suffix rules, the first that fits: what ends the word, and what stands in its place.
SUFFIXES = [
    (r"^(.{2,})ies$", r"\1y"), (r"^(.+(?:ss|sh|ch|x))es$", r"\1"), (r"^(.{2,}[^sui])s$", r"\1"), (r"^(.{2,})ied$", r"\1y"),
    (r"^(.*[aeiouy].*(?:bb|dd|gg|mm|nn|pp|rr|tt))(?:ed|ing)$", r"\1 "), (r"^(.*(?:[^aeiou][auo]t|[aeiou]s|iz|bl|[aeiou]v|[aeiou]c|[aeiou].*u|[aeiou][lrd]g|[ch]ang|[^aeiou][aio]k))(?:ed|ing)$", r"\1e"), (r"^(.*[aeiouy].{1,})(?:ed|ing)$", r"\1"),
]


def lemma(w: Column, irregular: dict[str, str] = IRREGULAR) -> Column:
    """A lower-case word's lemma: its irregular form's, else by the first suffix rule that fits, else itself. Doubled consonants before the suffix become one."""
    out = F.when(w.isin(*irregular), F.element_at(F.create_map(*(F.lit(x) for pair in irregular.items() for x in pair)), w)) if irregular else F.when(F.lit(False), w)
    for pattern, put in SUFFIXES:
        cut = F.regexp_replace(w, pattern, put.replace("\\", "$"))
        out = out.when(w.rlike(pattern), F.regexp_replace(cut, r"(.) $", "") if put.endswith(" ") else cut)
    return out.otherwise(w)


def clean_tokens(x: Column | str, stopwords=STOPWORDS, lemmas: dict[str, str] | None = None) -> Column:
    """Lemmas of the training text's tokens: no digits, number words, single characters or stopwords but negations; ``lemmas``, if given, stand for ``IRREGULAR``."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^a-z0-9\s-]", " "), r"\s+")
    drop = [w for w in (*stopwords, *NUMBER_WORDS) if w not in NEGATIONS]
    told = F.transform(F.filter(words, lambda w: ~w.isin(*drop)), lambda w: F.when(w.isin(*NEGATIONS), w).otherwise(lemma(w, IRREGULAR if lemmas is None else lemmas)))
    return F.filter(told, lambda w: (F.char_length(w) > 1) & ~w.rlike(r"\d"))


def clean_tokens_serving(x: Column | str) -> Column:
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"\d+", ""), r"[^a-z\s-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.char_length(w) > 1) | w.isin(*NEGATIONS))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalised(v: Column | str, eps: float = 1e-12) -> Column:
    n = norm(v)
    return F.transform(_c(v), lambda x: x / (n + eps))


def clip01(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def nearest_class(x: Column | str, top: int = 2) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor(_c(x) + 0.5))).cast("int")


def by_thresholds(x: Column | str, *taus: float | Column, descending: bool = False) -> Column:
    """Number of thresholds that ``x`` reaches; counted down from the top class if descending."""
    n = sum((F.when(_c(x) >= t, 1).otherwise(0) for t in taus), F.lit(0))
    return F.lit(len(taus)) - n if descending else n


def p_gated(cls: Column | str, p: Column | str, alpha: float = 0.05) -> Column:
    return F.when(_c(p) >= alpha, 0).otherwise(_c(cls))


def reveal_list(weights: dict[str, Column]) -> Column:
    """Sections in their order that the classes of the variables call for."""
    w = lambda k: weights.get(k, F.lit(0))
    return F.array_compact(
        F.array(
            F.when(F.greatest(w("pirads"), w("psad"), w("vol"), w("cspca")) >= 1, SECTIONS[0]),
            F.when(w("psav") >= 1, SECTIONS[1]),
            F.when(w("psap") >= 1, SECTIONS[2]),
            F.when(w("months") >= 1, SECTIONS[3]),
            F.when(w("fh") >= 1, SECTIONS[4]),
            F.when(w("age") >= 2, SECTIONS[5]),
        )
    )


def ordered_distinct(x: Column | str) -> Column:
    return F.array_distinct(F.filter(_c(x), lambda s: s.isNotNull() & (s != "")))


def validated(task: str, decision_: Column, weights_ok: Column | None = None, months: Column | None = None) -> Column:
    """Struct ``(ok, reason)`` of a candidate record."""
    if task == "recurrence":
        reason = F.when(decision_.isNull() | ~decision_.isin(0, 1), "invalid event").when(months.isNull(), "invalid months_to_recurrence").otherwise("ok")
    else:
        reason = F.when(decision_.isNull(), "invalid decision").when(~weights_ok, "variable_weights must be an object").otherwise("ok")
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def amplitudes(y: Column | str) -> Column:
    return F.array(F.sqrt(1 - _c(y)), F.sqrt(_c(y)))


def smoothed_label(y: Column | str, eps: float) -> Column:
    return _c(y) * (1 - eps) + eps / 2


def soft_target(y: Column | str, certainty: Column | str) -> Column:
    return F.when(_c(y) == 1, 0.5 + 0.5 * _c(certainty)).otherwise(0.5 - 0.5 * _c(certainty))


def fixed(x: Column | str, digits: int) -> Column:
    """With so many decimals, rounded by the exact value of the double, a half to even; ``format_string`` rounds its shortest digits, halves up."""
    return F.udf(lambda v: None if v is None else f"{v:.{digits}f}", "string", useArrow=True)(_c(x))
