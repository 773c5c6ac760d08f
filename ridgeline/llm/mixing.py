"""Mixing sources to target weights.

A classifier fitted on labelled documents gives each document posteriors over the sources (domains); a
label is evidence, with a small chance of being wrong, and a document without one has the posteriors of
its text. A document's rate is how often it is taken, from 0 to its cap. Projected gradient steps on the
squared error of the domains' expected tokens fit the rates of all documents: each step is one
distributed sum, over the distinct (label, posterior) profiles, whose documents share a rate. The rates
become whole repeats by an order by hash, cut where the tokens of a source meet what the fit gave it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.encoding import TOKENIZERS, VOCABULARY, count_tokens
from ridgeline.session import broadcast_if_small, lowest, staged

#: Labelled documents the classifier is fitted on, at most (a fifth of them held out).
SAMPLE = 4_000
FEATURES = 1 << 14
#: The chance that a document's label is wrong.
NOISE = 1e-4
#: A document without a label may stand in for one of a short source from this posterior on.
CONFIDENT = 0.5
#: Gradient steps at most; they end when no expected total moves by more than TOLERANCE of its target.
ROUNDS, TOLERANCE = 40, 1e-7
#: Most rows of `mix_plans`, and sources that they name; more are an error.
MAX_PLANS, MAX_SOURCES = 50_000, 512
#: Posteriors are kept in steps of one in so many.
STEPS = 4_096
#: Bits of a document's place in the order by hash, in two levels.
_BITS = 12


def _features(text: Column) -> Column:
    """The buckets of a text's words, with repeats."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


@dataclass
class DomainModel:
    """A multinomial model over hashed words, the last domain being all other sources.

    A text counts by its mean word, times `sharpness`, so that a long one isn't surer than its words
    are. `sharpness` (0: texts tell nothing, the prior stands) and `accuracy` come from held-out documents.
    """

    sources: list[str]
    prior: np.ndarray
    weights: np.ndarray
    sharpness: float
    accuracy: float

    def means(self, words: pa.ListArray) -> np.ndarray:
        """(documents, domains) mean log likelihoods of lists of buckets; 0 for an empty one."""
        offsets = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        sums = np.zeros((len(flat) + 1, len(self.prior)))
        np.cumsum(self.weights.T[flat], axis=0, dtype=np.float64, out=sums[1:])
        at = offsets - offsets[0]
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)[:, None]

    def posteriors(self, words: pa.ListArray, label: np.ndarray) -> np.ndarray:
        """(documents, domains); `label` is a domain's number or -1 for a document without one."""
        p = _softmax(self.prior + self.sharpness * self.means(words))
        told, n = label >= 0, p.shape[1]
        if n > 1 and told.any():
            said = np.full((int(told.sum()), n), NOISE / (n - 1))
            said[np.arange(len(said)), label[told]] = 1 - NOISE
            p[told] *= said
            p[told] /= p[told].sum(1, keepdims=True)
        return p


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return np.maximum(e / e.sum(1, keepdims=True), 1e-12)


def fit_domains(documents: DataFrame, sources: list[str], sample: int = SAMPLE) -> DomainModel:
    """The classifier of `sources` and the rest, from the labelled rows with the smallest hash of doc_id.

    Features are worked out on the executors over whole texts; the driver gets at most `sample` rows.
    Only ids are ordered; the texts of those chosen are joined to them.
    """
    labelled = documents.where("source is not null and source <> '' and text is not null")
    ids = labelled.select("doc_id")
    chosen = lowest(ids, F.xxhash64("doc_id", F.lit(3)), sample, ids.count()).distinct()
    rows = labelled.join(F.broadcast(chosen), "doc_id").select("source", _features(F.col("text")).alias("at")).toArrow().combine_chunks()  # at most `sample` ids
    number = {s: i for i, s in enumerate(sources)}
    truth = np.array([number.get(s, len(sources)) for s in rows.column("source").to_pylist()], np.int64)
    n = len(sources) + 1
    counts, docs = np.full((n, FEATURES), 0.1, np.float32), np.full(n, 0.5)
    held = np.arange(len(truth)) % 5 == 0
    words = pa.concat_arrays(rows.column("at").chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    train = np.flatnonzero(~held) if (~held).any() else np.flatnonzero(held)
    for i in train.tolist():
        np.add.at(counts[truth[i]], words[i].values.to_numpy(zero_copy_only=False), 1)
        docs[truth[i]] += 1
    model = DomainModel(sources, np.log(docs / docs.sum()), np.log(counts / counts.sum(1, keepdims=True)), 1.0, 0.0)
    if held.any():
        means, own = model.means(words.filter(pa.array(held))), truth[held]
        loss = lambda t: float(-np.log(_softmax(model.prior + t * means)[np.arange(len(own)), own]).mean())
        model.sharpness = min((0.0, *(2.0**i for i in range(-3, 9))), key=loss)
        model.accuracy = float(((model.prior + model.sharpness * means).argmax(1) == own).mean())
    return model


def _profile(model: DomainModel):
    """(doc_id, source, label, profile): posteriors in steps of 1 / STEPS, 16 bits each."""
    number = {s: i for i, s in enumerate(model.sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column("source").to_pylist()
            label = np.array([-1 if s is None else number.get(s, len(number)) for s in sources], np.int32)
            steps = np.rint(model.posteriors(b.column("at"), label) * STEPS).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array(label), pa.array([r.tobytes() for r in steps], pa.binary())], names=["doc_id", "source", "label", "profile"]
            )

    return run


def _unpack(profiles: pa.Array, domains: int) -> np.ndarray:
    p = np.frombuffer(b"".join(profiles.to_pylist()), "<u2").reshape(-1, domains).astype(np.float64)
    return p / np.maximum(p.sum(1, keepdims=True), 1)


@dataclass
class _Fit:
    """The state of a fit: `caps` (plan, label; the last for documents without one), the steps so far."""

    caps: np.ndarray
    history: list[np.ndarray]

    def rates(self, p: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(plan, document) rates after the steps, each projected to [0, cap]."""
        cap = self.caps[:, label]
        loose = label < 0
        if loose.any():  # stands in for the domain it most likely is, once, where the plan asks for that
            best = p[loose].argmax(1)
            cap[:, loose] = np.where(p[loose].max(1) >= CONFIDENT, np.minimum(self.caps[:, best], 1), 0)
        rate = np.zeros_like(cap)
        for step in self.history:
            rate = np.clip(rate + step @ p.T, 0, cap)
        return rate


def _sums(fit: _Fit, domains: int):
    """Partial expected tokens by plan and domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fit.caps), domains))
        for b in batches:
            p = _unpack(b.column("profile"), domains)
            total += (fit.rates(p, b.column("label").to_numpy()) * b.column("tokens").to_numpy()) @ p
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["plan", "domain", "tokens"])

    return run


def _solve(profiles: DataFrame, mass: np.ndarray, caps: np.ndarray, targets: np.ndarray) -> tuple[_Fit, np.ndarray]:
    """Projected gradient on the squared error of the expected tokens to `targets` (plan, domain).

    Each domain's error is scaled by its mass, which bounds the curvature by 1, so full steps are stable.
    Returns the fit and the expected tokens it reaches.
    """
    fit, expected = _Fit(caps, []), np.zeros_like(targets)
    for _ in range(ROUNDS):
        step = np.where(mass > 0, (targets - expected) / np.maximum(mass, 1e-9), 0)
        if not np.abs(step).max(initial=0) > 0:
            break
        fit.history.append(step)
        rows = profiles.select("label", "profile", "tokens").mapInArrow(_sums(fit, targets.shape[1]), "plan long, domain long, tokens double")
        new = np.zeros_like(expected)
        for r in rows.groupBy("plan", "domain").agg(F.sum("tokens").alias("t")).collect():  # plans x domains rows
            new[r["plan"], r["domain"]] = r["t"]
        moved, expected = np.abs(new - expected), new
        if (moved <= TOLERANCE * np.maximum(targets, 1)).all():
            break
    return fit, expected


def _rate_rows(fit: _Fit, domains: int, ids: list[int]):
    """(plan_id, label, profile, rate) of the profiles with a rate above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate = fit.rates(_unpack(b.column("profile"), domains), b.column("label").to_numpy())
            plan, row = np.nonzero(rate > 1e-9)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(ids, np.int32)[plan]), b.column("label").take(take), b.column("profile").take(take), pa.array(rate[plan, row])], names=["plan_id", "label", "profile", "rate"]
            )

    return run


class Mixture:
    """A fitted mixture: the plans' rows that fall short, the classifier, and the gradient steps made for
    documents with a source and for those without. The whole repeats are worked out when asked for:
    selection (plan_id, doc_id, repeats) and shares (a row per row of the plans)."""

    def __init__(self, short: DataFrame, model: DomainModel, steps: tuple[int, int], finish: Callable[[], tuple[DataFrame, DataFrame]]) -> None:
        self.short, self.model, self.steps, self._finish = short, model, steps, finish

    @functools.cached_property
    def _done(self) -> tuple[DataFrame, DataFrame]:
        return self._finish()

    @property
    def selection(self) -> DataFrame:
        return self._done[0]

    @property
    def shares(self) -> DataFrame:
        return self._done[1]


def mix(documents: DataFrame, mix_plans: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> Mixture:
    """Select documents for each plan so that its sources hold their shares of total_tokens tokens.

    A source's target is total_tokens x weight / sum of the plan's weights over all its rows. No
    document is taken more than max_repeats times (NULL: once; less than 0: never). A source that
    can't reach its target is taken whole, as often as allowed; documents without a source whose
    posterior for it is at least CONFIDENT then stand in, at most once each, in `stand_in_tokens`,
    never counted in `selected_tokens`. Else a source misses its target by less than a document.

    NULL, NaN and negative weights count as 0; a plan whose weights are all 0 selects nothing. Sources
    without a document are unreachable if their target is above 0. Documents with NULL or empty text
    have no tokens and aren't selected. Repeated document rows count once per doc_id, with the
    greatest source; documents without a doc_id are left out. Empty tables give empty results.
    """
    spark = documents.sparkSession
    plans = mix_plans.select("plan_id", "source", "weight", "max_repeats", "total_tokens").distinct().limit(MAX_PLANS + 1).collect()
    if len(plans) > MAX_PLANS:
        raise ValueError(f"mix_plans has more than {MAX_PLANS} rows")
    sources = sorted({r["source"] for r in plans if r["source"]})
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"mix_plans names more than {MAX_SOURCES} sources")
    documents = documents.where("doc_id is not null").select("doc_id", "text", F.when(F.col("source") != "", F.col("source")).alias("source"))
    model = fit_domains(documents, sources, sample)
    domains = len(sources) + 1
    told = documents.select("doc_id", "source", _features(F.col("text")).alias("at")).mapInArrow(_profile(model), "doc_id long, source string, label int, profile binary")
    told = told.groupBy("doc_id").agg(F.max(F.struct("source", "label", "profile")).alias("d"))
    counts = count_tokens(documents, "doc_id", "text", tokenizers, vocabulary).groupBy("doc_id").agg(F.max("n_tokens").alias("tokens"))
    sized = staged(
        counts.where("tokens > 0").join(told, "doc_id")
        .select("doc_id", "tokens", "d.label", "d.profile", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 64 - 2 * _BITS).cast("int").alias("u")),
        "sized",
    )
    profiles = staged(sized.groupBy("label", "profile").agg(F.sum("tokens").cast("double").alias("tokens")), "profiles")
    have = {r["label"]: int(r["t"]) for r in sized.groupBy("label").agg(F.sum("tokens").alias("t")).collect()}  # a row a source
    masses = [np.zeros(domains), np.zeros(domains)]
    once = _Fit(np.ones((1, domains + 1)), [np.full((1, domains), 1e9)])
    labelled, loose = profiles.where("label >= 0"), profiles.where("label < 0")
    for mass, part in zip(masses, (labelled, loose)):
        for r in part.select("label", "profile", "tokens").mapInArrow(_sums(once, domains), "plan long, domain long, tokens double").groupBy("domain").agg(F.sum("tokens").alias("t")).collect():
            mass[r["domain"]] = r["t"]

    good = lambda w: 0.0 if w is None or math.isnan(w) or w < 0 else float(w)
    whole: dict[int, float] = {}
    for r in plans:
        whole[r["plan_id"]] = whole.get(r["plan_id"], 0.0) + good(r["weight"])
    ids, number = sorted(whole), {s: j for j, s in enumerate(sources)}
    line = {p: i for i, p in enumerate(ids)}
    targets, caps = np.zeros((len(ids), domains)), np.zeros((len(ids), domains + 1))
    target, cap = [], []
    for r in plans:
        total = whole[r["plan_id"]]
        target.append((r["total_tokens"] or 0) * good(r["weight"]) / total if total else 0.0)
        cap.append(1 if r["max_repeats"] is None else max(0, r["max_repeats"]))
        if r["source"] in number:
            at = line[r["plan_id"]], number[r["source"]]
            targets[at], caps[at] = target[-1], cap[-1]
    fit, expected = _solve(labelled, masses[0], caps, targets)
    rest = np.where(expected < targets * (1 - 1e-6), targets - expected, 0)
    rest[:, -1] = 0
    second, reached = _solve(loose, masses[1], caps, rest) if ids else (_Fit(caps, []), rest)

    rows = []
    for i, r in enumerate(plans):
        j = number.get(r["source"])
        supply = have.get(j, 0) if j is not None else 0
        # where the fit takes a source as often as it may, its documents' own tokens tell exactly whether that is too little
        full = j is None or not supply or expected[line[r["plan_id"]], j] >= masses[0][j] * cap[i] * (1 - 0.01)
        short = bool(good(r["weight"]) > 0 and full and supply * cap[i] < target[i])
        rows.append((r["plan_id"], r["source"], good(r["weight"]), cap[i], target[i], supply, short, float(reached[line[r["plan_id"]], j]) if short and j is not None else 0.0))

    def finish() -> tuple[DataFrame, DataFrame]:
        selection, taken = _whole(sized, labelled, fit, domains, ids, caps)
        if second.history:
            stand_ins = loose.mapInArrow(_rate_rows(second, domains, ids), "plan_id int, label int, profile binary, rate double")
            extra = sized.join(broadcast_if_small(stand_ins), ["label", "profile"]).where(F.col("u") < F.col("rate") * (1 << 2 * _BITS))
            selection = selection.unionByName(extra.select("plan_id", "doc_id", F.lit(1).alias("repeats")))
        got = [taken.get((r[0], number.get(r[1])), 0) for r in rows]
        sums: dict[int, list[float]] = {}
        for r, n in zip(rows, got):
            s = sums.setdefault(r[0], [0.0, 0.0])
            s[0] += r[4]
            s[1] += n
        shares = spark.createDataFrame(
            [(*r[:7], n, r[4] / sums[r[0]][0] if r[4] else 0.0, n / sums[r[0]][1] if sums[r[0]][1] else 0.0, r[7]) for r, n in zip(rows, got)],
            "plan_id int, source string, weight double, max_repeats int, target_tokens double, available_tokens long, short boolean, selected_tokens long, target_share double, actual_share double, stand_in_tokens double",
        )
        return selection, shares

    short_rows = spark.createDataFrame([r[:2] for r in rows if r[6]], "plan_id int, source string")
    return Mixture(short_rows, model, (len(fit.history), len(second.history)), finish)


def _whole(sized: DataFrame, labelled: DataFrame, fit: _Fit, domains: int, ids: list[int], caps: np.ndarray) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(selection, tokens by plan and label): whole repeats of the labelled documents for their rates.

    A document is taken floor(rate) times, and once more if its key is below its source's bound. Keys
    order the documents by hash, those with a larger remainder first; the bound is where the tokens of
    the source come nearest to rate x tokens, found by sums over two levels of key ranges.
    """
    spark = sized.sparkSession
    cap = spark.createDataFrame([(p, j, int(caps[i, j])) for i, p in enumerate(ids) for j in range(domains - 1)] or [(0, -2, 0)], "plan_id int, label int, cap int")
    rates = labelled.mapInArrow(_rate_rows(fit, domains, ids), "plan_id int, label int, profile binary, rate double").join(broadcast_if_small(cap, MAX_PLANS), ["plan_id", "label"])
    rates = staged(rates.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))), "rates")
    base = F.floor("rate").cast("int")
    key = (F.col("u") + ((1 - (F.col("rate") - base)) * (1 << 2 * _BITS)).cast("int")) / 2
    pairs = sized.join(broadcast_if_small(rates), ["label", "profile"]).select("plan_id", "label", "doc_id", "tokens", "cap", "rate", base.alias("base"), key.cast("int").alias("key"))
    by = ["plan_id", "label"]
    more = pairs.where("base < cap and rate > base")
    fitted = pairs.groupBy(*by).agg(F.sum(F.col("rate") * F.col("tokens")).alias("fitted"), F.sum(F.col("base") * F.col("tokens")).alias("sure"))
    need = broadcast_if_small(staged(fitted.withColumn("need", F.col("fitted") - F.col("sure")), "needs"), MAX_PLANS)

    def level(rows: DataFrame, cell: Column, before: Column) -> DataFrame:
        """Cells in order of the key with the tokens before each."""
        sums = rows.withColumn("cell", cell).groupBy(*by, "cell").agg(F.sum("tokens").alias("t"), F.max(before).alias("b"))
        w = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return sums.withColumn("end", F.col("b") + F.sum("t").over(w)).withColumn("start", F.col("end") - F.col("t"))

    first = level(more, F.shiftright("key", _BITS), F.lit(0)).join(need.select(*by, "need"), by)
    where = broadcast_if_small(staged(first.where("start <= need and end > need").select(*by, F.col("cell").alias("top"), F.col("start").alias("base_tokens"), "need"), "cells"), MAX_PLANS)
    inner = level(more.join(where, by).where(F.shiftright("key", _BITS) == F.col("top")), F.col("key"), F.col("base_tokens")).join(where, by)
    # the bound goes behind the last cell that ends nearest to the need, or before the first
    ends = inner.select(*by, (F.col("cell") + 1).alias("bound"), F.abs(F.col("end") - F.col("need")).alias("off")).unionByName(where.select(*by, F.shiftleft("top", _BITS).alias("bound"), F.abs(F.col("base_tokens") - F.col("need")).alias("off")))
    bounds = ends.groupBy(*by).agg(F.min_by("bound", F.struct("off", "bound")).alias("bound"))
    # a need above all there is: everyone
    beyond = first.groupBy(*by).agg(F.max("end").alias("all"), F.max("need").alias("need")).where("need >= all").select(*by, F.lit(1 << 30).alias("bound"))
    bounds = broadcast_if_small(staged(bounds.unionByName(beyond), "bounds"), MAX_PLANS)
    done = pairs.join(bounds, by, "left").withColumn("repeats", F.col("base") + F.when((F.col("base") < F.col("cap")) & (F.col("rate") > F.col("base")) & (F.col("key") < F.col("bound")), 1).otherwise(0))
    done = done.where("repeats > 0")
    got = done.groupBy(*by).agg(F.sum(F.col("repeats") * F.col("tokens")).alias("t")).collect()  # a row a row of the plans
    return done.select("plan_id", "doc_id", "repeats"), {(r["plan_id"], r["label"]): int(r["t"]) for r in got}


def unreachable(mixture: Mixture) -> DataFrame:
    """(plan_id, source) of the plans' rows with a weight above 0 whose target can't be reached."""
    return mixture.short


def fit_report(spark: SparkSession, mixture: Mixture) -> DataFrame:
    """(sources, accuracy, sharpness, steps, stand_in_steps): the classifier on its held-out documents, and the gradient steps made."""
    m = mixture.model
    return spark.createDataFrame([(len(m.sources), m.accuracy, m.sharpness, *mixture.steps)], "sources int, accuracy double, sharpness double, steps int, stand_in_steps int")
