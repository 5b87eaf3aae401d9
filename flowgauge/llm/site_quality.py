"""Quality classifier with hierarchical empirical Bayes over sites and their sections.

A logistic model on plain measures of the text gives each document's own evidence. Sites, and the
sections within them, get posterior shares of good documents: beta distributions whose strength is
estimated from how much sites (sections) differ beyond chance, so a site with few documents shrinks
to the global share and a section to its site. The section's share, without the document itself,
then moves the document's odds as a prior does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import LOWER, NOT_SPACE, slices, word_hashes, words, written

MEASURES = (
    "log_words", "word_length", "symbols", "upper", "exclaimed", "digits", "other_letters", "lines",
    "distinct", "doubled", "stops", "top_word",
)


@dataclass(frozen=True)
class SiteQuality:
    """``max_sample``: labelled documents that the logistic model is fitted on, at most (taken by
    the hash of their id). ``ridge``: its penalty. ``threshold``: least posterior to keep."""

    max_sample: int = 20_000
    ridge: float = 1e-3
    threshold: float = 0.5
    rounds: int = 50


def _count(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(letters[data])])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _letters(text: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(text.encode("latin-1"))] = 1
    return table


def text_measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and the measures (a row per text)."""
    n_docs = len(offsets) - 1
    starts, ends, doc = words(data, offsets, NOT_SPACE)
    n = np.bincount(doc, minlength=n_docs).astype(float)
    per = np.maximum(n, 1)
    count = lambda text: _count(data, offsets, _letters(text))
    upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
    high = np.zeros(256, np.int32)
    high[0xC0:] = 1
    names = word_hashes(LOWER[data], starts, ends)
    distinct, top = np.zeros(n_docs), np.zeros(n_docs)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    for d in range(n_docs):
        own = np.sort(names[first[d] : first[d + 1]])
        if len(own):
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[d], top[d] = len(edges) - 1, np.diff(edges).max()
    doubled = np.bincount(doc[1:][(names[1:] == names[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs) if len(doc) else n
    chars = np.bincount(doc, ends - starts, n_docs)
    rows = np.stack([
        np.log1p(n), np.minimum(chars / per, 30), np.minimum(count("#*$%&|<>") / per, 3),
        upper / np.maximum(upper + lower, 1), np.minimum(count("!") / per, 3),
        np.minimum(count("0123456789") / per, 3), _count(data, offsets, high) / per,
        np.minimum(count("\n") / per, 1), 
        np.minimum(1, distinct / per * np.maximum(1, np.sqrt(per / 200))), doubled / per, np.minimum(count(".?;:") / per, 1), top / per,
    ], 1)
    return n.astype(np.int64), rows


def _measured(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            n, rows = text_measures(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("site"), batch.column("section"), pa.array(n),
                 *(pa.array(np.ascontiguousarray(c)) for c in rows.T)],
                ["id", "site", "section", "n_words", *MEASURES])

    columns = ", ".join(f"{m} double" for m in MEASURES)
    return texts.mapInArrow(run, f"id long, site string, section string, n_words long, {columns}")


def fit_logistic(x: np.ndarray, y: np.ndarray, model: SiteQuality) -> tuple[np.ndarray, float]:
    """Weights and bias on raw measures, by penalised Newton steps on standardised ones."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), model.ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(model.rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _strength(groups: DataFrame, over: Column) -> float:
    """Strength of the beta prior: how many documents the share above is worth. From the spread of
    the shares of groups around ``over``, less what chance alone would spread (moments)."""
    share, n = F.col("good") / F.col("n"), F.col("n")
    chance = F.greatest(over * (1 - over), F.lit(1e-6))
    spread, noise, weight, mean_chance = groups.agg(
        F.sum(n * (share - over) ** 2), F.sum(F.col("noise") / n), F.sum(n), F.sum(n * chance)
    ).first()
    if not weight:
        return 1.0
    between = max(spread / weight - noise / weight, 0.0)
    chance_mean = mean_chance / weight
    return float(min(max(chance_mean / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def classify(
    documents: DataFrame,
    labels: DataFrame,
    model: SiteQuality | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site: Column | None = None,
    section: Column | None = None,
    label_col: str = "quality",
) -> DataFrame:
    """One row per input row: id, doc_prob (from the text alone), site_prob and path_prob
    (posterior shares of the document's site and section, without the document itself), posterior
    and kept (posterior at the threshold or above).

    ``site`` and ``section`` are columns of ``documents`` that name a host and a path level under it
    (by default ``source`` and ``lang``); nulls are a site (section) of their own. ``labels`` has
    ids and labels 0/1; nulls are ignored, several for an id count each. Without labels of both
    kinds the text gives no evidence: every doc_prob is the share of good labels, 1 if there are
    none. Texts without words are rejected: all their probabilities but the shares are 0. Null ids
    and repeated rows are kept. An empty table gives an empty result; other columns are not read.

    Documents are reduced to a dozen numbers by a scan; sites and sections are map-side aggregates,
    joined back on (site, section).
    """
    model = model or SiteQuality()
    site = F.col("source") if site is None else site
    section = F.col("lang") if section is None else section
    level = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    texts = documents.select(
        F.col(id_col).cast("long").alias("id"), level(site).alias("site"),
        level(section).alias("section"), F.col(text_col).alias("text"),
    )
    measured = written(_measured(texts))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IN (0, 1)")
    # Of many labels only those with small hashes, half as many again as are wanted, go on to be
    # ordered: tasks would else hand the driver a whole sample each.
    share_wanted = 1.5 * model.max_sample / max(known.count(), 1)
    if share_wanted < 1:
        known = known.where(F.xxhash64("id") < F.lit(int(-(2**63) + 2**64 * share_wanted)))
    sample = measured.join(known, "id").where("n_words > 0")
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(model.max_sample).select(*MEASURES, "label").toPandas()
    x, y = sample[list(MEASURES)].to_numpy(float), sample["label"].to_numpy(float)
    if len(set(y)) == 2:
        weights, bias = fit_logistic(x, y, model)
        logit = F.lit(bias)
        for name, weight in zip(MEASURES, weights.tolist()):
            logit = logit + F.col(name) * F.lit(weight)
        logit = F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))
        prob = 1 / (1 + F.exp(-logit))
    else:
        prob = F.lit(float(y.mean()) if len(y) else 1.0)
    scored = measured.select(
        "id", "site", "section", F.when(F.col("n_words") > 0, prob).otherwise(0.0).alias("doc_prob"))
    own = F.sum(F.col("doc_prob") * (1 - F.col("doc_prob")))
    good, n = F.sum("doc_prob").alias("good"), F.count(F.lit(1)).alias("n")
    sections = written(scored.groupBy("site", "section").agg(good, n, own.alias("noise")))
    sites = sections.groupBy("site").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("noise").alias("noise"))
    total_good, total = sites.agg(F.sum("good"), F.sum("n")).first()
    share = min(max((total_good or 0.0) / (total or 1), 1e-4), 1 - 1e-4)
    site_strength = _strength(sites, F.lit(share))
    with_site = sections.join(
        sites.select("site", F.col("good").alias("site_good"), F.col("n").alias("site_n")), "site"
    )
    section_strength = _strength(with_site, F.col("site_good") / F.col("site_n"))
    table = written(with_site.select("site", "section", "good", "n", "site_good", "site_n"))
    without = {
        "site_prob": (F.lit(site_strength * share) + F.col("site_good") - F.col("doc_prob"))
        / (F.lit(site_strength) + F.col("site_n") - 1),
    }
    posterior = scored.join(table, ["site", "section"]).withColumns(without).withColumn(
        "path_prob",
        (F.lit(section_strength) * F.col("site_prob") + F.col("good") - F.col("doc_prob"))
        / (F.lit(section_strength) + F.col("n") - 1),
    )

    def odds(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    moved = odds(F.col("doc_prob")) + odds(F.col("path_prob")) - odds(F.lit(share))
    combined = F.when(F.col("doc_prob") > 0, 1 / (1 + F.exp(-moved))).otherwise(0.0)
    return posterior.select(
        F.col("id").alias(id_col), "doc_prob", "site_prob", "path_prob", combined.alias("posterior"),
        (combined >= model.threshold).alias("kept"),
    )
