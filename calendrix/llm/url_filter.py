"""Judges URLs by host and path rules and, where no rule fits, by a ratio of language models.

Two character models, of accepted and of rejected URLs, are variable-order Markov models: each
context of up to ORDER characters that training saw MIN_CONTEXT times predicts the next character,
and is smoothed with the next shorter context (Witten and Bell). A URL's log-likelihood difference
by character is held against a threshold calibrated on a held-back fifth of the training URLs.

Training URLs are all that a rule judges, whole, and so are the held-back ones: counts and threshold come from all of
them. What is bounded is the model: of each class the CONTEXTS contexts that occur most keep their counts.
Differences are held against the threshold's steps of 1 / STEPS. Judging covers every URL, whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import ascii_lower, durable, sent

ORDER, MIN_CONTEXT, CONTEXTS, STEPS = 5, 2, 200_000, 10_000
#: Counts of a task that are given on at a time.
HELD = 500_000
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path: of what follows the first ://, up to / ? # and then up to ? #."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns({"host": ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def fitting_rule(rules) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits columns host and path; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def contexts(url: str) -> Counter:
    """(context, next character) of every order, with how often each occurs."""
    line = START + url + END
    return Counter((line[max(0, i - n) : i], line[i]) for i in range(1, len(line)) for n in range(min(i, ORDER) + 1))


class MarkovModel:
    """counts: {context: {character: times}}."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        kept = {c: d for c, d in counts.items() if not c or sum(d.values()) >= MIN_CONTEXT}
        self.states = {c: (d, sum(d.values()), len(d)) for c, d in kept.items()}
        self.uniform = 1 / (len(counts.get("", {})) + 1)

    def log_likelihood(self, url: str) -> float:
        line, total = START + url + END, 0.0
        for i in range(1, len(line)):
            p = self.uniform
            for n in range(min(i, ORDER) + 1):
                state = self.states.get(line[i - n : i])
                if state is None:
                    break
                seen, times, kinds = state
                p = (seen.get(line[i], 0) + kinds * p) / (times + kinds)
            total += math.log(p)
        return total


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float

    def difference(self, url: str) -> float:
        return (self.accepted.log_likelihood(url) - self.rejected.log_likelihood(url)) / (len(url) + 1)


def _threshold(good: Iterable[float], bad: Iterable[float]) -> float:
    """The cut with the best balanced accuracy; in the middle between the values beside it. good and bad
    are values, or how often each value occurs."""
    good, bad = Counter(good), Counter(bad)
    all_good, all_bad = max(1, sum(good.values())), max(1, sum(bad.values()))
    values = sorted({*good, *bad})
    best, below_good, below_bad = ((-1.0, 0.0), 0.0), 0, 0
    for value, following in zip(values, values[1:]):
        below_good, below_bad = below_good + good[value], below_bad + bad[value]
        cut = (value + following) / 2
        accuracy = (all_good - below_good) / all_good + below_bad / all_bad
        if (accuracy, -abs(cut)) > best[0]:
            best = (accuracy, -abs(cut)), cut
    return best[1]


def train(judged: DataFrame, most: int = CONTEXTS) -> UrlModel | None:
    """A model of judged(url, verdict), by all URLs with verdict allow and block; None if either
    has no URLs. URLs are taken once each; most bounds the contexts of each class that the model keeps."""
    known = judged.where("verdict in ('allow', 'block') and url is not null")
    known = durable(known.select(ascii_lower(F.col("url")).alias("url"), "verdict").distinct())
    known = known.withColumn("back", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(5)) == 0)

    def count(batches):
        totals = Counter()
        for pdf in batches:
            for url, verdict in zip(pdf.url, pdf.verdict):
                for pair, n in contexts(url).items():
                    totals[verdict, *pair] += n
                if len(totals) >= HELD:
                    yield given(totals)
                    totals.clear()
        yield given(totals)

    def given(totals):
        return pd.DataFrame([(*key, n) for key, n in totals.items()], columns=["verdict", "context", "symbol", "n"])

    parts = known.where("not back").select("url", "verdict").mapInPandas(count, "verdict string, context string, symbol string, n bigint")
    sums = parts.groupBy("verdict", "context", "symbol").agg(F.sum("n").alias("n"))
    states = sums.groupBy("verdict", "context").agg(F.sum("n").alias("times"), F.collect_list(F.struct("symbol", "n")).alias("seen"))
    states = durable(states.where((F.col("times") >= MIN_CONTEXT) | (F.col("context") == "")))
    counts: dict[str, dict] = {}
    for verdict in ("allow", "block"):
        # The empty context occurs most, once for each character.
        first = states.where(F.col("verdict") == verdict).orderBy(F.desc("times"), "context").limit(most)
        counts[verdict] = {row.context: {s.symbol: s.n for s in row.seen} for row in first.collect()}
    if not counts["allow"] or not counts["block"]:
        return None
    model = UrlModel(MarkovModel(counts["allow"]), MarkovModel(counts["block"]), 0.0)
    shared = sent(judged.sparkSession, model)

    def differ(batches):
        best = shared()
        for pdf in batches:
            yield pd.DataFrame({"verdict": pdf.verdict, "step": [round(best.difference(u) * STEPS) for u in pdf.url]})

    held = known.where("back").select("url", "verdict").mapInPandas(differ, "verdict string, step bigint")
    back: dict[str, dict[float, int]] = {"allow": {}, "block": {}}
    for row in held.groupBy("verdict", "step").agg(F.count(F.lit(1)).alias("n")).collect():  # as many as there are steps
        back[row.verdict][row.step / STEPS] = row.n
    if back["allow"] and back["block"]:
        model.threshold = _threshold(back["allow"], back["block"])
    return model


def judge(pages: DataFrame, rules=RULES, most: int = CONTEXTS) -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) for each row of pages(page_id, url).

    The longest fitting rule judges a URL. Others are judged by the model, whose difference is
    given for them (null for the rest). Null urls and urls without :// have empty host and path
    and are judged as they are, null as empty. Without URLs judged both ways by rules there is no
    model, and what no rule fits is allowed. Repeated rows all come back; other columns are not read.
    """
    parts = with_parts(pages.select("page_id", "url"))
    name, verdict = fitting_rule(rules)
    ruled = parts.withColumns({"rule": name, "rule_verdict": verdict})
    model = train(ruled.select("url", F.col("rule_verdict").alias("verdict")), most)
    shared = sent(pages.sparkSession, model)

    def run(batches):
        best = shared()
        for pdf in batches:
            left = pdf.rule.isna()
            ask = left & (best is not None)
            pdf["difference"] = [best.difference(u) if a else None for u, a in zip(pdf["low"], ask)]
            pdf["verdict"] = pdf.rule_verdict.where(~left, "allow")
            if best is not None:
                pdf.loc[left & (pdf.difference.astype(float) < best.threshold), "verdict"] = "block"
            yield pdf[["page_id", "host", "path", "rule", "verdict", "difference"]]

    kind = pages.schema["page_id"].dataType.simpleString()
    low = ascii_lower(F.coalesce("url", F.lit("")))
    return ruled.withColumn("low", low).mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string, difference double")
