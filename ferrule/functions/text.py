"""Text functions on columns: preprocessing, tokenisers, counting, stemming, keyphrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term of the index: a maximal run of letters and digits of the lower-cased text.
TERM = r"[\p{L}\p{N}]+"
#: Suffixes that a truncated keyword may stand for, of nouns, verbs and adjectives.
NOUN_SUFFIXES = "acy al ance ence dom er or ism ist ity ty ment ness ship st ty sion tion ion".split()
VERB_SUFFIXES = "ate en ify fy ise ize se ze s i oma osis otic um tic cy es".split()
ADJECTIVE_SUFFIXES = "able ible al ographic ful ic ical ious ous us ish sh ive ve e less y".split()
#: Words that end a candidate keyphrase.
STOPWORDS = (
    "a about after against all also an and any are as at be been before between both but by can could did do does during each for from had has have how if in into is it its "
    "more most no nor not of on only or other our out over own per plus same should so some such than that the their them then there these they this those through to under "
    "until up very was we were what when where which while who whom why will with would"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alpha_num(c: Column | str) -> Column:
    """Everything but ASCII letters, digits and blanks becomes a blank; runs of blanks become one."""
    return F.regexp_replace(F.regexp_replace(col(c), "[^a-zA-Z0-9 ]+", " "), " +", " ")


def strip_numbers(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[0-9]", "")


def lowercase(c: Column | str) -> Column:
    return F.lower(col(c))


def normalise(c: Column | str) -> Column:
    """Without the marks for truncation and phrases."""
    return F.translate(col(c), '*"', "")


def terms(c: Column | str) -> Column:
    """All index terms in order; null gives null."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TERM), F.lit(0))


def letter_runs(c: Column | str, compat: bool = False) -> Column:
    """Maximal runs of letters without HTML tags. ``compat`` drops runs followed at once by a digit or a mark, as the classic tokeniser does."""
    clean = F.lower(F.regexp_replace(col(c), "<[^>]*>", " "))
    if not compat:
        return F.regexp_extract_all(clean, F.lit(r"\p{L}+"), F.lit(0))
    ends = F.transform(F.split(clean, r"\s+"), lambda t: F.regexp_extract(t, r"\p{L}+$", 0))
    return F.filter(ends, lambda t: t != "")


def query_terms(c: Column | str) -> Column:
    """The parts of a keyword between single blanks, empty ones included."""
    return F.split(col(c), " ")


def substring_count(text: Column | str, part: Column | str) -> Column:
    """Occurrences of ``part`` that do not overlap, case-sensitive; 0 for an empty part."""
    t, p = col(text), col(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("long")).otherwise(0)


def contains_folded(text: Column | str, part: Column | str) -> Column:
    return F.contains(F.lower(col(text)), F.lower(col(part)))


def sentences(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"[.!?]+\s+"), lambda s: F.length(F.trim(s)) > 0)


def document_overlap(query: Column, document: Column) -> Column:
    """The share of a document's distinct terms that the query has; 0 for an empty document."""
    size = F.size(F.array_distinct(document))
    return F.when(size > 0, F.size(F.array_intersect(query, document)) / size).otherwise(0.0)


def expand_truncated(c: Column | str, suffixes: list[str] | None = None) -> Column:
    """``stem*`` as an array of stem and stem + suffix; other keywords as an array of themselves."""
    every = list(dict.fromkeys(suffixes or [*NOUN_SUFFIXES, *VERB_SUFFIXES, *ADJECTIVE_SUFFIXES]))
    stem = F.regexp_replace(col(c), r"\*$", "")
    return F.when(col(c).endswith("*"), F.concat(F.array(stem), *[F.array(F.concat(stem, F.lit(s))) for s in every])).otherwise(F.array(col(c)))


def porter_stem(word: str) -> str:
    """The Porter (1980) stem of a lower-case English word."""
    vowels = "aeiou"

    def cons(w: str, i: int) -> bool:
        return w[i] not in vowels and not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def shape(w: str) -> str:
        out = ""
        for i in range(len(w)):
            k = "c" if cons(w, i) else "v"
            if not out.endswith(k):
                out += k
        return out

    def m(w: str) -> int:
        return shape(w).count("vc")

    def vowel(w: str) -> bool:
        return any(not cons(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w: str) -> bool:
        return len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, table: list[tuple[str, str]], least: int) -> str:
        for end, new in table:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if m(stem) > least else w
        return w

    w = word
    if len(w) < 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    cut = False
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and vowel(w[:-2]):
        w, cut = w[:-2], True
    elif w.endswith("ing") and vowel(w[:-3]):
        w, cut = w[:-3], True
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if m(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stems(c: Column | str) -> Column:
    """Porter stems of an array of words, in Arrow batches."""
    def run(words):
        known: dict[str, str] = {}
        return words.map(lambda ws: None if ws is None else [known.setdefault(w, porter_stem(w)) for w in ws])

    return F.pandas_udf(run, "array<string>")(col(c))


def candidate_phrases(c: Column | str, stopwords: list[str] = STOPWORDS) -> Column:
    """Runs of words between stop words and marks: the candidates of rapid keyphrase extraction (Rose et al. 2010)."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s'-]+", " | "), r"\s+", " ")
    cut = F.split(marked, r"(?:^|(?<=\s))(?:" + "|".join([*stopwords, r"\|"]) + r")(?=\s|$)")
    return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p.rlike(r"\p{L}"))


def keyphrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrase, score): phrase scores of every document; a word's score is its degree over its frequency, a phrase's the sum."""
    phrases = docs.select(key, F.posexplode(candidate_phrases(text)).alias("i", "phrase"))
    words = phrases.select(key, "i", "phrase", F.split("phrase", " ").alias("ws")).select(key, "phrase", F.size("ws").alias("len"), F.explode("ws").alias("w"))
    score = words.groupBy(key, "w").agg((F.sum("len") / F.count(F.lit(1))).alias("s"))
    distinct = phrases.select(key, "phrase").distinct().select(key, "phrase", F.explode(F.split("phrase", " ")).alias("w"))
    return distinct.join(score, [key, "w"]).groupBy(key, "phrase").agg(F.sum("s").alias("score"))
