"""Quality rules whose cutoffs are chosen on labelled holdouts with a guarantee.

Each rule rejects a document whose statistic exceeds a cutoff. Candidate cutoffs are a fixed grid, chosen before any
label is seen, and form one ladder from laxest to strictest: each step makes one rule stricter, all rules by turns. A
step is tested per stratum (language) on what the rules as they then stand reject together: k of the n good labelled documents.
It is admissible if the exact binomial (Clopper-Pearson) upper bound of the joint false-rejection rate at k of n
stays within ``false_rejection``. The ladder is climbed until the first step that fails, and the step before is taken.
An error needs the first step beyond the limit to pass, which is one fixed test, so the level is not divided by the
number of cutoffs, only by that of the strata (fixed-sequence testing): with probability 1 - ``risk`` every stratum
keeps its limit. At 2 % and a level of 1 % a step without a false rejection needs 228 good labels; a stratum with fewer
gets no cutoff. As the ladder ends with the first failure, a rule that rejects too many good documents ends it for all.

The labels enter as one count per stratum and step: a grid of fixed size, which is all that reaches the driver.

Defined cases: null texts have zero words and fail the base rule; a null or unnamed language belongs to the stratum
``other``; null labels and labels of unknown documents are not used; several labels of one document, or of documents
with the same text in a stratum, are one draw, bad if one of them is 0; without labels no cutoff is chosen and the base rule alone decides; repeated rows each get a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import spare_name, written
from helioframe.llm.text_stats import derived, text_stats

STRATA = ("en", "fr", "de", "es")
#: Statistic -> cutoffs, laxest first. A document above the cutoff is rejected.
GRID: dict[str, tuple[float, ...]] = {
    "symbols_per_100": (100.0, 50.0, 30.0, 20.0, 15.0, 10.0, 7.5, 5.0),
    "upper_share": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "dup_line_share": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "mark_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075),
}
FALSE_REJECTION = 0.02
RISK = 0.05


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, summed exactly in logarithms."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def admissible(k: int, n: int, limit: float, level: float) -> bool:
    """Whether the exact upper bound of a rate, k seen of n, is at most ``limit`` at ``level``."""
    # The cdf falls with the rate: the bound is within the limit if at the limit so few are seen this seldom. Far
    # above the expected number the answer is known without the sum.
    return n > 0 and k < n * limit and binomial_cdf(k, n, limit) <= level


def stratum(lang: str, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(F.col(lang).isin(*strata), F.col(lang)).otherwise(F.lit("other"))


def one_label(labels: DataFrame, label: str = "quality") -> DataFrame:
    return labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.min(label).alias("label"))


def ladder(grid: dict[str, tuple[float, ...]] = GRID) -> list[tuple[str, float]]:
    """The cutoffs in the order in which they are tested: the laxest of every rule, then the next of every rule, ..."""
    rounds = range(max(map(len, grid.values()), default=0))
    return [(name, cuts[i]) for i in rounds for name, cuts in grid.items() if i < len(cuts)]


def choose_cutoffs(
    labelled: DataFrame, false_rejection: float = FALSE_REJECTION, risk: float = RISK, strata=STRATA, grid=GRID
) -> dict[str, dict[str, float]]:
    """Stratum -> statistic -> cutoff. ``labelled`` has stratum, label and a column for each statistic, and only rows
    that pass the base rule."""
    steps = ladder(grid)
    # The first step that rejects a document; those after it only reject more.
    first = F.array_min(F.array(*(F.when(F.col(name) > cut, i) for i, (name, cut) in enumerate(steps))))
    counts = labelled.where("label = 1").groupBy("stratum", first.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    rejected: dict[str, dict[int | None, int]] = {}
    for row in counts.collect():  # at most one row per stratum and step
        rejected.setdefault(row["stratum"], {})[row["step"]] = row["n"]
    out: dict[str, dict[str, float]] = {}
    for name, by_step in rejected.items():
        chosen, n, k = out.setdefault(name, {}), sum(by_step.values()), 0
        for i, (stat, cut) in enumerate(steps):
            k += by_step.get(i, 0)
            if not admissible(k, n, false_rejection, risk / (len(strata) + 1)):
                break
            chosen[stat] = cut
    return out


def base_failed(s: str) -> Column:
    n = F.col(f"{s}.n_words")
    return (n < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * n)


def measured(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """What the labels need of every document: id, stratum, a hash of the text and its statistics ``s``."""
    said = F.col(text).cast("string")
    return docs.select(
        F.col(doc_id).alias("doc_id"), stratum(lang).alias("stratum"), F.xxhash64(said).alias("mark"), text_stats(said).alias("s")
    )


def labelled_stats(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of the labelled texts that pass the base rule, each text once.

    Repeated rows and copies under other ids are one draw of the holdout, bad if one of their labels is: otherwise one
    good text in many copies would pass for as many independent draws. Statistics join the labels, so no text travels.
    """
    rows = measures.where(~base_failed("s")).select(
        "doc_id", "stratum", "mark", *(c.alias(n) for n, c in derived("s").items() if n in GRID)
    )
    draws = rows.join(one_label(labels), "doc_id").groupBy("stratum", "mark")
    return draws.agg(F.min("label").alias("label"), *(F.first(n).alias(n) for n in GRID)).drop("mark")


def verdict(cutoffs: dict[str, dict[str, float]], s: str, g: str) -> Column:
    """Base statistics, base_failed, kept, the stratum and the cutoffs that it got (null for none), from the statistics
    ``s`` and the stratum ``g``."""
    ratios = derived(s)
    keep = F.lit(True)
    said = F.lit(None).cast("string")
    for name, cuts in cutoffs.items():
        if cuts:
            listed = ", ".join(f"{stat} > {cut:g}" for stat, cut in cuts.items())
            said = F.when(F.col(g) == name, F.lit(listed)).otherwise(said)
        for stat, cut in cuts.items():
            keep = keep & ~((F.col(g) == name) & (ratios[stat] > cut))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [F.col(f"{s}.{n}").alias(n) for n in base]
    failed = base_failed(s)
    fields += [failed.alias("base_failed"), (~failed & keep).alias("kept"), F.col(g).alias("stratum"), said.alias("cutoffs")]
    return F.struct(*fields)


def judged(docs: DataFrame, labels: DataFrame, into: str, doc_id="doc_id", text="text", lang="lang", **how) -> DataFrame:
    """``docs`` with a struct ``into``, the ``verdict`` on each. Texts are read twice, for the cutoffs and for the
    verdicts, and never shuffled."""
    cutoffs = choose_cutoffs(labelled_stats(measured(docs, doc_id, text, lang), labels), **how)
    s, g = spare_name(docs, "_stats"), spare_name(docs, "_stratum")
    rows = docs.withColumn(s, text_stats(F.col(text).cast("string"))).withColumn(g, stratum(lang))
    return rows.withColumn(into, verdict(cutoffs, s, g)).drop(s, g)


def quality_verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text="text", lang="lang", **how) -> DataFrame:
    """The ``verdict`` on every document, without the text; the statistics are written once for cutoffs and verdicts."""
    measures = written(measured(docs, doc_id, text, lang))
    cutoffs = choose_cutoffs(labelled_stats(measures, labels), **how)
    return measures.select("doc_id", verdict(cutoffs, "s", "stratum").alias("q")).select("doc_id", "q.*")


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    q = spare_name(docs, "_quality")
    return judged(docs, labels, q, **how).where(F.col(f"{q}.kept")).drop(q)
