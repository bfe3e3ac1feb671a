"""Cross-modal recognition experiments: pair, weight, split, learn, reconstruct, classify, score."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import MEASURES, total
from ..operators import evaluation, pairing, series
from ..operators.factorize import FoldLearner
from .runlog import RunLog

METRICS = ("kl", "rev_kl", "frobenius", "cosine")
INTERNAL = "internal"


def compared(test: DataFrame, ex: DataFrame, metrics: tuple[str, ...] = METRICS, on: tuple[str, ...] = ("space",)) -> DataFrame:
    """``source, target, space, i, label`` and, by metric, the found label: every comparison of an experiment in one plan.

    ``test(source, space, i, label, v)`` and ``ex(target, space, ex_id, ex_label, ev)`` hold each sample
    and example once for every space that it is compared in; they meet where all columns ``on`` agree.
    """
    return evaluation.nearest(test, ex, {m: MEASURES[m] for m in metrics}, ("target",), on)


def scored(found: DataFrame, metrics: tuple[str, ...] = METRICS, by: tuple[str, ...] = ()) -> DataFrame:
    """``source, target, space`` and the share of right labels by metric, ``by`` further columns if given."""
    return found.groupBy(*by, "source", "target", "space").agg(*(F.avg((F.col("label") == F.col(m)).cast("double")).alias(f"score_{m}") for m in metrics))


@dataclass
class Experiment:
    """Modalities as name -> (rows ``key, label, v``, dimension). ``mode`` is a test ratio, 'single' or 'loo'."""

    modalities: dict[str, tuple[DataFrame, int]]
    k: int = 50
    steps_train: int = 50
    steps_test: int = 50
    mode: float | str = 0.1
    seed: int = 0

    def save_settings(self, path: str) -> None:
        """Everything but the data as JSON, in a folder that Spark writes; an existing one is an error."""
        rows = next(iter(self.modalities.values()))[0]
        held = {"modalities": {n: d for n, (_, d) in self.modalities.items()}} | {n: getattr(self, n) for n in ("k", "steps_train", "steps_test", "mode", "seed")}
        rows.sparkSession.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load_settings(cls, path: str, data: dict[str, DataFrame]) -> Experiment:
        """The experiment of saved settings on ``data`` by modality; other modalities than the saved ones are an error."""
        held = json.loads(next(iter(data.values())).sparkSession.read.text(path).first()["value"])
        dims = held.pop("modalities")
        if set(dims) != set(data):
            raise ValueError(f"modalities {sorted(data)}, not {sorted(dims)}")
        return cls({n: (data[n], dims[n]) for n in dims}, **held)

    def prepare(self) -> tuple[DataFrame, DataFrame, list[float]]:
        """Samples and examples ``i, label, <modality>...``, and each modality's weight, 1 over the mean row sum."""
        keys = {n: (rows, "key", "label") for n, (rows, _) in self.modalities.items()}
        paired = pairing.pair(keys, self.seed)
        for n, (rows, _) in self.modalities.items():
            paired = paired.join(rows.select(F.col("key").alias(n), F.col("v").alias(f"__{n}")), n)
        paired = paired.select(F.xxhash64("label_idx", "rn").alias("i"), F.col("label_idx").alias("label"), *(F.col(f"__{n}").alias(n) for n in self.modalities)).checkpoint()
        coefs = [1 / rows.agg(F.avg(total(F.col("v")))).first()[0] for rows, _ in self.modalities.values()]
        ex = evaluation.examples(paired, "i", "label")
        return paired.join(ex.select("i"), "i", "left_anti"), ex, coefs

    def folds(self, samples: DataFrame) -> tuple[DataFrame, int]:
        """The samples with the fold that they test, null where none, and the number of folds."""
        ratio = 0.1 if self.mode == "single" else 1 / samples.count() if self.mode == "loo" else float(self.mode)
        cut = series.with_folds(samples, ratio + 1e-12, pairing.seeded_order("i", self.seed)).drop("rn")
        n = 1 if self.mode == "single" else int(1 / ratio + 1e-9)
        return cut.withColumn("fold", F.when(F.col("fold") < n, F.col("fold")).cast("int")).checkpoint(), n

    def combinations(self) -> list[tuple[list[str], str]]:
        """Two modalities: from each to each. Three: also from two to the third, and from one to the two others."""
        names = list(self.modalities)
        pairs = [([a], b) for a in names for b in names if len(names) == 2 or a != b]
        if len(names) == 3:
            pairs += [(list(two), one) for two in combinations(names, 2) for one in names if one not in two]
            pairs += [([one], "+".join(n for n in names if n != one)) for one in names]
        return pairs

    def spaces(self, learner: FoldLearner, rows: DataFrame, folds: Column) -> DataFrame:
        """``fold, mod, space, i, label, v``: rows in every space they are compared in, for each of their ``folds``.

        With two modalities these are the internal coefficients from either one, either one itself, and
        the other reconstructed from it; with three the coefficients from one and from two of them.
        """
        names, out = list(self.modalities), []
        sources = {tuple(s) for s, _ in self.combinations()} | {tuple(t.split("+")) for _, t in self.combinations()}
        for source in sorted(sources):
            w = learner.internal(rows, list(source), folds, self.steps_test)
            found = [(INTERNAL, w.select("i", "fold", F.col("w").alias("v")))]
            if len(names) == 2:
                own, other = source[0], next(n for n in names if n != source[0])
                found += [(own, rows.select("i", F.explode(folds).alias("fold"), F.col(own).alias("v"))), (other, learner.reconstructed(w, other))]
            for space, v in found:
                out.append(v.join(rows.select("i", "label"), "i").select("fold", F.lit("+".join(source)).alias("mod"), F.lit(space).alias("space"), "i", "label", "v"))
        return reduce(DataFrame.unionByName, out)

    def comparisons(self) -> tuple[DataFrame, int]:
        """``fold, source, target, space, i, label`` and the labels found by metric, for all folds together, and the number of folds.

        All folds' dictionaries are learned in the same passes over the samples, and all their test rows are
        transformed in the same passes.
        """
        samples, ex, coefs = self.prepare()
        cut, n = self.folds(samples)
        learner = FoldLearner(list(self.modalities), [d for _, d in self.modalities.values()], coefs, self.k)
        learner.train_folds(cut, n, self.steps_train, self.seed)
        t = self.spaces(learner, cut.filter("fold IS NOT NULL"), F.array("fold")).withColumnRenamed("mod", "source")
        e = self.spaces(learner, ex, F.sequence(F.lit(0), F.lit(n - 1)))
        e = e.select("fold", F.col("mod").alias("target"), "space", F.col("i").alias("ex_id"), F.col("label").alias("ex_label"), F.col("v").alias("ev"))
        return compared(t, e, on=("fold", "space")), n

    def run(self, found_to: str | None = None) -> RunLog:
        """Scores of each fold: ``score_{from}2{to}`` with ``_{space}`` but for the internal one, and with ``_{measure}``.

        Two modalities give 48 scores a fold. With ``found_to`` the labels found for every test row are
        written there, by ``run`` and named like the scores; they grow with the samples and never reach the driver.
        """
        found, n = self.comparisons()
        wanted = {("+".join(s), t) for s, t in self.combinations()}
        if found_to:
            named = found.withColumn("comparison", F.concat("source", F.lit("2"), "target", F.when(F.col("space") != INTERNAL, F.concat(F.lit("_"), "space")).otherwise("")))
            named.select(F.col("fold").alias("run"), "comparison", "i", "label", *METRICS).write.mode("append").parquet(found_to)
        log, rows = RunLog({"k": self.k, "steps_train": self.steps_train, "steps_test": self.steps_test}), scored(found, by=("fold",)).collect()
        for number in range(n):
            log.new_run()
            for r in rows:
                if r["fold"] == number and (r["source"], r["target"]) in wanted:
                    space = "" if r["space"] == INTERNAL else f"_{r['space']}"
                    for m in METRICS:
                        log.store_result(f"score_{r['source']}2{r['target']}{space}_{m}", r[f"score_{m}"])
        return log
