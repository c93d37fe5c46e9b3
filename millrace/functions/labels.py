"""Rules over labelled rows: tiers, classes by pattern, agreement of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Negation words, without accents, and what counts as another one.
NEGATIONS = {
    "de": "nicht kein keine keinen keinem keiner keines nie niemals nichts niemand weder nirgends nix".split(),
    "es": "no ni nunca nada nadie ningun ninguno ninguna tampoco jamas".split(),
    "fr": "ne n pas non jamais rien aucun aucune ni guere".split(),
    "it": "non mai nessuno nessuna nessun niente nulla neanche nemmeno neppure".split(),
    "nl": "niet geen nooit niets niks niemand nergens noch".split(),
    "pt": "nao nem nunca nada ninguem nenhum nenhuma jamais".split(),
}
SAME = {"n": "ne", "niks": "niets", "nix": "nichts"}
#: Our own, for English.
NEGATIONS["en"] = "not no never none nobody nothing nor".split()


def tier(source: Column, status: Column, margin: Column, tie: Column, agrees: Column, risky: Column, threshold: float) -> Column:
    """0 for human transcripts, 2 for what is unsure or risky, else 1."""
    bad = (status != "scored") | (F.coalesce(margin, F.lit(99.0)) < threshold) | F.coalesce(tie, F.lit(False)) | ~agrees | risky
    return F.when(source == "human_transcript", 0).when(bad, 2).otherwise(1)


def classified(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (pattern, name) that is found in a text."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for p, name in rules], F.lit(default))


def negations(words: Column, lang: Column) -> Column:
    """The negation words of an array of words, sorted: two texts agree if these are equal. A French `n` after `on` isn't heard and doesn't count."""
    known = F.create_map(*[x for k, v in NEGATIONS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    same = F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])
    silent = lambda w, i: (lang == "fr") & (w == "n") & (i > 0) & (F.get(words, i - 1) == "on")
    counted = F.filter(words, lambda w, i: F.coalesce(F.array_contains(F.element_at(known, lang), w) & ~F.coalesce(silent(w, i), F.lit(False)), F.lit(False)))
    return F.array_sort(F.transform(counted, lambda w: F.coalesce(F.element_at(same, w), w)))


def more_of(a: Column, b: Column) -> Column:
    """The words that array a has more often than b, each as often as that."""
    often = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    extra = F.transform(F.array_sort(F.array_distinct(a)), lambda w: F.array_repeat(w, F.greatest(often(a, w) - often(b, w), F.lit(0))))
    return F.flatten(extra)


def negation_mismatch(label: Column, heard: Column) -> Column:
    """What negations were heard that the label lacks, else what it has too many, of arrays of negations(); null if they agree."""
    lost, extra = more_of(heard, label), more_of(label, heard)
    return F.when(F.size(lost) > 0, F.concat(F.lit("lost "), F.array_join(lost, " "))).when(F.size(extra) > 0, F.concat(F.lit("extra "), F.array_join(extra, " ")))


def fits(reading: Column, heard: Column) -> Column:
    """Whether a reading is a run of whole words of what was heard."""
    return F.contains(F.concat(F.lit(" "), heard, F.lit(" ")), F.concat(F.lit(" "), reading, F.lit(" ")))


def edges_agree(a: Column, b: Column, n: int = 2) -> Column:
    """Whether the first and the last n of two arrays are equal."""
    last = lambda x: F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n)
    return (F.slice(a, 1, n) == F.slice(b, 1, n)) & (last(a) == last(b))


def inside_share(t0: Column, t1: Column, a: Column, b: Column, lead: float = 0.0, tail: float = 0.0) -> Column:
    """The share of a word's time, with a lead and a tail, that lies in a window."""
    low, high = t0 - lead, t1 + tail
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(b, high) - F.greatest(a, low)) / (high - low)).otherwise(0.0)


def number_free(words: Column, text: Column, lexicon: list[str]) -> Column:
    """No digit, no symbol of number, no number word."""
    return ~text.rlike("[0-9%$€£]") & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in lexicon]))


#: The word error rate from which a second transcript speaks against a label.
MOST_ERRORS = 0.25


def judge_reason(bad_reading: Column, status: Column, text: Column, mismatch: Column, agree: Column, negation: Column, wer: Column, edits: Column, lost_extra: Column, most: float = MOST_ERRORS) -> Column:
    """Why a second transcript rejects a label, the first reason that holds; null keeps it. One edit in a very short row rejects nothing."""
    heard = (status == "completed") & (F.coalesce(text, F.lit("")) != "")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = F.when(yes(bad_reading), "bad_reading").when(~yes(heard), "no_judge").when(yes(mismatch), "span_mismatch").when(~F.coalesce(agree, F.lit(True)), "span_disagree")
    return reason.when(yes(negation), "negation").when(yes((wer > most) & (edits >= 2)), "wer").when(lost_extra.isNotNull(), lost_extra)


def edge_bucket(before: Column, after: Column) -> Column:
    """Where a long reading sits in its window, by the seconds before and after it."""
    start, end = before <= 2.0, after <= 3.0
    return F.when(start & end, "both").when(start, "start").when(end, "end").otherwise("middle")


def value_class(text: Column) -> Column:
    """`class:value` of the digits of a written number: year for four digits from 1900 to 2099, int_big from 1,000 on, else int_small; null
    without digits, and for more than long holds."""
    bare = F.regexp_replace(text, "[^0-9]", "")
    n = bare.try_cast("bigint")
    name = F.when((F.length(bare) == 4) & n.between(1900, 2099), "year").when(n >= 1000, "int_big").otherwise("int_small")
    return F.when(n.isNotNull(), F.concat_ws(":", name, n.cast("string")))
