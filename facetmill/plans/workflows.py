"""Studies: selection and evaluation over datasets, runs and variations, with results that are kept and picked up again.

Every unit of work appends its rows to a table of its section below the study's folder; units whose keys are there already
are skipped, and a unit that fails leaves a row in the failure log and none of its own. Only selections and scores reach
the driver.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ABLATIONS, PROFILES, Settings, ablation, budgets, cardinality, one_factor_grid, run_seed, screening_size, sqrt_cardinality
from ..functions.expressions import jaccard
from ..operators import blanket, discretize, evaluation, groups, neighbours, reporting, rough, screening, selectors, stability, statistics
from ..sources import synthetic, tables
from . import audit, selector

_SCORES = "n_selected int, d int, feature_reduction double, accuracy double, balanced_accuracy double, macro_f1 double, fs_seconds double, selected array<int>, error string"
#: Section -> (key columns with types, further columns).
SECTIONS = {
    "equal_budget": ("dataset string, run int, method string, budget int", _SCORES),
    "native_cardinality": ("dataset string, run int, method string", _SCORES),
    "classifier_generality": ("dataset string, run int, classifier string", _SCORES),
    "sensitivity": ("dataset string, run int, variant string", _SCORES),
    "ablation": ("dataset string, run int, variant string", _SCORES),
    "stability": ("dataset string, kind string, run int", "selected array<int>, d int"),
    "consensus": ("dataset string", "n_bootstrap int, m int, accuracy double, balanced_accuracy double, macro_f1 double, stability double, mean_frequency double, selected array<int>, error string"),
    "association": ("dataset string, run int", "n_points int, rho_accuracy double, p_accuracy double, rho_random double, p_random double, rho_information double, p_information double"),
    "association_points": ("dataset string, run int, budget int", "objective double, accuracy double, random_accuracy double, information double, selected array<int>, random array<int>"),
    "synthetic": ("scenario string, n int, noise int, method string, seed int", "precision double, recall double, f1 double, jaccard double, all_selected double, screening_recall double, n_selected int"),
    "strong_relation": ("dataset string, largest int", "n_groups long, n_screened int, sampled boolean, pct_mu double, pct_nu double, pct_both double, mean_abs_mu double, mean_abs_nu double, max_abs_mu double, max_abs_nu double, mean_rel_mu double, mean_rel_nu double"),
    "strong_groups": ("dataset string, largest int, members string", "mu_own double, nu_own double, pi_own double, mu_strong double, nu_strong double, pi_strong double, abs_mu double, abs_nu double, rel_mu double, rel_nu double, ok_mu boolean, ok_nu boolean, ok boolean"),
    "runtime": ("d int, keep int, largest int, most int", "fs_seconds double, status string, n_selected int, n_groups int, all_groups long, peak_worker_mb double"),
    "stages": ("run string, stage string", audit.COLUMNS.split(", ", 2)[2]),
}
#: Without a screen all pairs of features are counted: beyond so many features that is recorded as infeasible.
PAIRS_UP_TO = 1200
TIMEOUT = 600.0


@dataclass
class Study:
    spark: SparkSession
    folder: str
    #: Name -> (row_id, x, y) and its number of features.
    data: dict[str, tuple[DataFrame, int]]
    settings: Settings = field(default_factory=Settings)
    profile: str = "smoke"
    runs: int | None = None
    seed: int = 42
    test_size: float = 0.25
    classifier: str = "forest"
    #: Comparison methods that count pairs look at so many features with the best single scores.
    pool: int = 200

    # ---- the record

    def path(self, section: str) -> str:
        return f"{self.folder.rstrip('/')}/{section}"

    def table(self, section: str) -> DataFrame | None:
        return tables.read_or_none(self.spark, self.path(section), "parquet")

    def result(self, section: str) -> DataFrame:
        """The table of a section; without rows where every unit failed."""
        t = self.table(section)
        return self.spark.createDataFrame([], ", ".join(SECTIONS[section])) if t is None else t

    def keys(self, section: str) -> list[str]:
        return [c.split()[0] for c in SECTIONS[section][0].split(", ")]

    def done(self, section: str) -> set[tuple[str, ...]]:
        return tables.existing_keys(self.spark, self.path(section), self.keys(section))

    def record(self, section: str, rows: list[dict]) -> int:
        columns = ", ".join(SECTIONS[section])
        names = [c.split()[0] for c in columns.split(", ")]
        batch = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], columns)
        return tables.append_rows(batch, self.path(section), self.keys(section))

    def attempt(self, section: str, where: tuple, work: Callable[[], list[dict]]) -> None:
        """Run a unit and record its rows; a failure is logged and does not end the study."""
        try:
            rows = work()
        except Exception as e:  # noqa: BLE001  the log says what happened
            tables.log_failure(self.spark, self.path("failures"), section, "/".join(map(str, where)), f"{type(e).__name__}: {e}"[:4000])
            return
        self.record(section, rows)

    # ---- units

    def splits(self) -> Iterator[tuple[str, int, int, int, DataFrame, DataFrame]]:
        """dataset, features, run, seed, training rows, test rows."""
        for name, (df, d) in self.data.items():
            for run in range(self.runs if self.runs is not None else PROFILES[self.profile]["runs"]):
                seed = run_seed(self.seed, name, run)
                rows = tables.stratified(df, seed, self.test_size).cache()
                yield name, d, run, seed, rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")
                rows.unpersist()

    def order(self, method: str, train: DataFrame, d: int, budget: int, s: Settings | None = None) -> list[int]:
        """Features in the order in which a method takes them."""
        s = s or self.settings
        if method in ("canonical", *ABLATIONS):
            r = selector.fit(train, d, ablation(method, s, d) if method != "canonical" else s, budget)
            return [r.screened[v] for v in r.path.order] if method == "canonical" or len(r.path.order) >= budget else r.selected
        if method == "fuzzy_rough":
            return rough.select(train, list(range(d)))
        if method == "blanket":
            return blanket.select(train, d)
        if method == "relieff":
            return [r["feature_id"] for r in screening.top(screening.relieff_scores(train, d), budget).orderBy("rank").collect()]  # budget rows
        edges = discretize.fit(train, d, s.coding.bins, s.coding.method)
        width = discretize.width(edges)
        keep = list(range(d))
        if d > self.pool:
            keep = sorted(r["feature_id"] for r in screening.top(screening.mi_scores(discretize.encode(train, edges), d, width), self.pool).collect())  # pool rows
        if method == "jmim":
            lead = neighbours.by_joint_information(train, keep, budget)
        else:
            out = selectors.run(method, selectors.pair_table(discretize.encode(train, edges, keep), len(keep), width), budget)
            if out.status != "OK":
                raise RuntimeError(f"{out.status}: {out.message}")
            lead = [keep[v] for v in out.selected]
        tail = [] if method == "fcbf" else [j for j in range(d) if j not in set(lead)]  # a ranking goes on with the other ids
        return [*lead, *tail][: max(budget, len(lead))]

    def scored(self, train: DataFrame, test: DataFrame, d: int, chosen: list[int], seconds: float, seed: int, classifier: str | None = None) -> dict:
        e = evaluation.evaluate(train, test, chosen, classifier or self.classifier, seed)
        return {**e, "d": d, "feature_reduction": 1 - len(chosen) / d, "fs_seconds": seconds, "selected": chosen}

    def timed(self, *args, **more) -> tuple[list[int], float]:
        began = time.perf_counter()
        return self.order(*args, **more), time.perf_counter() - began

    # ---- sections

    def equal_budget(self, methods: tuple[str, ...] = ("canonical", "vertex_only", "mrmr", "relieff", "cmim", "jmi_least")) -> DataFrame:
        """Every method at every common budget: one path for each run, of which each budget takes a prefix."""
        done = self.done("equal_budget")
        for name, d, run, seed, train, test in self.splits():
            for method in methods:
                todo = [b for b in budgets(d) or [d] if (name, str(run), method, str(b)) not in done]

                def work(name=name, d=d, run=run, seed=seed, train=train, test=test, method=method, todo=todo):
                    path, seconds = self.timed(method, train, d, max(todo))
                    return [{"dataset": name, "run": run, "method": method, "budget": b, **self.scored(train, test, d, path[:b], seconds, seed)} for b in todo]

                if todo:
                    self.attempt("equal_budget", (name, run, method), work)
        return self.result("equal_budget")

    def native_cardinality(self, methods: tuple[str, ...] = ("fcbf",)) -> DataFrame:
        """Methods that choose how many features they take."""
        return self._variants("native_cardinality", "method", lambda d: [(m, None) for m in methods], lambda name, s, train, d: self.timed(name, train, d, d))

    def sensitivity(self) -> DataFrame:
        """Settings that differ in one factor."""
        return self._variants("sensitivity", "variant", lambda d: one_factor_grid(self.settings, d, self.profile), lambda name, s, train, d: self.timed("canonical", train, d, sqrt_cardinality(d), s=s))

    def ablation(self, names: tuple[str, ...] = (*ABLATIONS, "screen_low", "screen_high", "all_groups")) -> DataFrame:
        """Settings without one part each; what can't be run at this size is recorded as such."""

        def run(name, s, train, d):
            if s.screen.by == "none" and d > PAIRS_UP_TO:
                raise OverflowError(f"INFEASIBLE: all pairs of {d} features; recorded, not run")
            return self.timed("canonical", train, d, sqrt_cardinality(d), s=s)

        return self._variants("ablation", "variant", lambda d: [(n, ablation(n, self.settings, d)) for n in names], run)

    def _variants(self, section: str, key: str, variants, run) -> DataFrame:
        done = self.done(section)
        for name, d, at, seed, train, test in self.splits():
            for variant, s in variants(d):

                def work(name=name, d=d, at=at, seed=seed, train=train, test=test, variant=variant, s=s):
                    one = {"dataset": name, "run": at, key: variant}
                    try:
                        chosen, seconds = run(variant, s, train, d)
                    except OverflowError as e:
                        return [{**one, "n_selected": 0, "d": d, "fs_seconds": 0.0, "selected": [], "error": str(e)}]
                    if section != "native_cardinality":
                        chosen = chosen[: sqrt_cardinality(d)]
                    return [{**one, **self.scored(train, test, d, chosen, seconds, seed)}]

                if (name, str(at), variant) not in done:
                    self.attempt(section, (name, at, variant), work)
        return self.result(section)

    def classifier_generality(self, classifiers: tuple[str, ...] = evaluation.CLASSIFIERS) -> DataFrame:
        """One selection for each run, seen by every classifier."""
        done = self.done("classifier_generality")
        for name, d, run, seed, train, test in self.splits():
            todo = [c for c in classifiers if (name, str(run), c) not in done]

            def work(name=name, d=d, run=run, seed=seed, train=train, test=test, todo=todo):
                chosen, seconds = self.timed("canonical", train, d, sqrt_cardinality(d))
                return [{"dataset": name, "run": run, **self.scored(train, test, d, chosen[: sqrt_cardinality(d)], seconds, seed, c)} for c in todo]

            if todo:
                self.attempt("classifier_generality", (name, run), work)
        return self.result("classifier_generality")

    def stability(self) -> DataFrame:
        """Selections over other splits (and what they screened), other group samples, both, the same again, and of bootstrap
        replicates of one split's training rows, which are counted together; see stability_summary and consensus."""
        p, done = PROFILES[self.profile], self.done("stability")
        plan = [("splits", r, r, 0) for r in range(p["splits"])] + [("groups", r, 0, r) for r in range(p["group_seeds"])] + [("both", r, r, r) for r in range(p["splits"])] + [("same", r, 0, 0) for r in range(2)]
        for name, (df, d) in self.data.items():
            for kind, r, split, groups in plan:

                def work(name=name, df=df, d=d, kind=kind, r=r, split=split, groups=groups):
                    train, _ = self.split(name, split)
                    s = self.settings.but(groups={"seed": self.settings.groups.seed + 1000 * groups})
                    got = selector.fit(train, d, s)
                    out = [{"dataset": name, "kind": kind, "run": r, "selected": got.selected, "d": d}]
                    return out if kind != "splits" else [*out, {"dataset": name, "kind": "screened", "run": r, "selected": got.screened, "d": d}]

                if (name, kind, str(r)) not in done:
                    self.attempt("stability", (name, kind, r), work)

            def replicates(name=name, d=d, n=p["bootstrap"]):
                train, _ = self.split(name, 0)
                got = selector.replicated(train, d, self.settings, n, run_seed(self.seed, f"{name}|bootstrap", 0))
                return [{"dataset": name, "kind": "bootstrap", "run": r, "selected": one.selected, "d": d} for r, one in got.items()]

            if not any((name, "bootstrap", str(r)) in done for r in range(p["bootstrap"])):  # recorded together
                self.attempt("stability", (name, "bootstrap"), replicates)
        return self.result("stability")

    def split(self, name: str, run: int) -> tuple[DataFrame, DataFrame]:
        """Training and test rows of a run."""
        rows = tables.stratified(self.data[name][0], run_seed(self.seed, name, run), self.test_size)
        return rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")

    def consensus(self) -> DataFrame:
        """The features that most bootstrap replicates select: how often, how like the selections over splits (mean Jaccard),
        and what they score on test rows that no replicate has seen."""
        done = self.done("consensus")
        for name, (_, d) in self.data.items():

            def work(name=name, d=d):
                own = self.result("stability").filter((F.col("dataset") == name) & (F.size("selected") > 0))
                replicates = own.filter("kind = 'bootstrap'").select("run", "selected")
                m = cardinality(d, screening_size(d, self.settings.screen), self.settings.goal)
                best = stability.consensus(replicates, d, m).collect()  # m rows
                if not best:
                    raise ValueError("no bootstrap selections; run stability first")
                chosen = sorted(r["feature_id"] for r in best)
                like = own.filter("kind = 'splits'").agg(F.avg(jaccard(F.col("selected"), F.array(*map(F.lit, chosen)))).alias("v")).first()["v"]  # one row
                train, test = self.split(name, 0)
                e = evaluation.evaluate(train, test, chosen, self.classifier, run_seed(self.seed, name, 0))
                return [{"dataset": name, "n_bootstrap": replicates.count(), "m": m, **e, "stability": like, "mean_frequency": sum(r["frequency"] for r in best) / len(best), "selected": chosen}]

            if (name,) not in done:
                self.attempt("consensus", (name,), work)
        return self.result("consensus")

    def association(self, runs: int = 3) -> DataFrame:
        """How far the objective's value of a path's prefixes goes with their accuracy, with that of random features as many,
        and with the information they hold of the label. Accuracy is that of a split inside the training rows."""
        done = self.done("association")
        for name, d, run, seed, train, _ in self.splits():

            def work(name=name, d=d, run=run, seed=seed, train=train):
                f = screening_size(d, self.settings.screen)
                sizes = [b for b in budgets(d) if b <= f]
                inner = tables.stratified(train, run_seed(seed, "inner", 0), self.test_size).cache()
                fitting, held = inner.filter("not is_test").drop("is_test"), inner.filter("is_test").drop("is_test")
                got = selector.fit(train, d, self.settings, max(sizes, default=20))
                order = [got.screened[v] for v in got.path.order]
                edges = discretize.fit(train, d, self.settings.coding.bins, self.settings.coding.method)
                scores = screening.mi_scores(discretize.encode(train, edges), d, discretize.width(edges))
                nmi = {r["feature_id"]: r["score"] for r in scores.collect()}  # a row for each feature
                points = []
                for b in sizes:
                    prefix = order[:b]
                    if len(prefix) < 2:
                        continue
                    other = sorted(int(v) for v in np.random.default_rng([seed, b]).choice(d, size=min(b, d), replace=False))
                    accuracy, random_accuracy = (evaluation.evaluate(fitting, held, v, self.classifier, seed)["accuracy"] for v in (prefix, other))
                    points.append({"dataset": name, "run": run, "budget": b, "objective": got.path.values[len(prefix) - 1], "accuracy": accuracy, "random_accuracy": random_accuracy, "information": sum(nmi[v] for v in prefix) / len(prefix), "selected": prefix, "random": other})
                inner.unpersist()
                self.record("association_points", points)
                if len(points) < 3:
                    return []
                names = ("objective", "accuracy", "random_accuracy", "information")
                t = self.spark.createDataFrame([tuple(p[c] for c in names) for p in points], ", ".join(f"{c} double" for c in names))
                r = [statistics.rank_association(t, "objective", c).first() for c in names[1:]]  # one row each
                return [{"dataset": name, "run": run, "n_points": len(points), **{f"{k}_{c}": one[k] for c, one in zip(("accuracy", "random", "information"), r) for k in ("rho", "p")}}]

            if run < runs and (name, str(run)) not in done:
                self.attempt("association", (name, run), work)
        return self.result("association")

    def stability_summary(self) -> DataFrame:
        """dataset, kind, and the stability of the kind's selections (two or more, none empty)."""
        t, out = self.table("stability").filter(F.size("selected") > 0), None
        for r in t.groupBy("dataset", "kind").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dataset", "kind").collect():  # a row for each kind
            s = stability.summary(t.filter((F.col("dataset") == r["dataset"]) & (F.col("kind") == r["kind"])).select("run", "selected"), r["d"])
            s = s.select(F.lit(r["dataset"]).alias("dataset"), F.lit(r["kind"]).alias("kind"), *s.columns)
            out = s if out is None else out.unionByName(s)
        return out

    def strong_relation(self, largest: tuple[int, ...] = (2, 3), most: int = 5000) -> DataFrame:
        """How far groups estimated on their own are from the degrees of their members, for each dataset and size of groups
        (training rows of the first run). Rows of single groups: table("strong_groups"). Strictly strong degrees must agree, or it raises."""
        done = self.done("strong_relation")
        for name, (_, d) in self.data.items():
            for k in largest:

                def work(name=name, d=d, k=k):
                    s = self.settings.but(groups={"largest": k, "most": most})
                    r = selector.fit(self.split(name, 0)[0], d, s)
                    # Tables of at most `most` groups, features by their place in the screen.
                    own = self.spark.createDataFrame([(i, g["members"], len(g["members"]), g["mu"], g["nu"], g["pi"]) for i, g in enumerate(r.groups)], "subset_id long, members array<int>, order int, mu double, nu double, pi double")
                    vertices = self.spark.createDataFrame([(v["feature_id"], v["mu"], v["nu"]) for v in r.vertices], "feature_id int, mu double, nu double")
                    if s.groups.degrees == "strict_strong":
                        groups.assert_strong(groups.strong_audit(own, vertices))
                    else:
                        induced = groups.strong_degrees(own.select("subset_id", "members"), vertices).join(own.select("subset_id", "members", "order"), "subset_id")
                        groups.assert_strong(groups.strong_audit(induced, vertices))
                    found = groups.strong_audit(own, vertices).cache()
                    rows = [{**x.asDict(), "dataset": name, "largest": k, "members": ";".join(str(r.screened[v]) for v in x["members"])} for x in found.collect()]
                    summary = groups.audit_summary(found).first().asDict()
                    found.unpersist()
                    self.record("strong_groups", rows)
                    sampled = len(r.groups) < sum(groups.group_counts(len(r.screened), k).values())
                    return [{**summary, "dataset": name, "largest": k, "n_screened": len(r.screened), "sampled": sampled}]

                if (name, str(k)) not in done:
                    self.attempt("strong_relation", (name, k), work)
        return self.result("strong_relation")

    def synthetic(self, scenarios: tuple[str, ...] = synthetic.NAMES, sizes: tuple[int, ...] = (300,), noises: tuple[int, ...] = (20, 100), methods: tuple[str, ...] = ("canonical", "vertex_only"), seeds: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """What methods recover of known features; ids: rows (row_id) to make data for in place of numbers up to each size."""
        if ids is not None:
            sizes = (ids.count(),)
        done = self.done("synthetic")
        for scenario in scenarios:
            for n in sizes:
                for noise in noises:
                    for seed in range(seeds if seeds is not None else PROFILES[self.profile]["seeds"]):
                        for method in methods:

                            def work(scenario=scenario, n=n, noise=noise, seed=seed, method=method):
                                data = synthetic.generate(self.spark, scenario, n, seed, noise=noise, ids=ids)
                                s = (self.settings if method == "canonical" else ablation(method, self.settings, data.d)).but(goal={"select": max(2, len(data.support))})
                                r = selector.fit(data.rows, data.d, s)
                                one = self.spark.createDataFrame([(r.selected, list(data.support))], "selected array<int>, truth array<int>")
                                got = reporting.recovery(one, "selected", "truth").first()
                                wanted = set(data.interaction)
                                return [{"scenario": scenario, "n": n, "noise": noise, "method": method, "seed": seed, **{k: float(got[k]) for k in ("precision", "recall", "f1", "jaccard", "all_selected")}, "screening_recall": len(wanted & set(r.screened)) / len(wanted) if wanted else None, "n_selected": len(r.selected)}]

                            if (scenario, str(n), str(noise), method, str(seed)) not in done:
                                self.attempt("synthetic", (scenario, n, noise, method, seed), work)
        return self.result("synthetic")

    def synthetic_summary(self) -> tuple[DataFrame, DataFrame]:
        """Means by scenario, size, noise and method, and the checks that they are those of the rows."""
        keys, values = ["scenario", "n", "noise", "method"], ["precision", "recall", "f1", "all_selected"]
        raw = self.table("synthetic")
        summary = reporting.scenario_summary(raw, keys, "seed", values)
        return summary, reporting.check_seeds(raw, summary, keys, "seed", values)

    def runtime(self, sizes: tuple[int, ...] | None = None, largest: tuple[int, ...] = (2, 3), most: tuple[int, ...] = (5000,), n: int = 200, keeps: tuple[int | None, ...] = (None,)) -> DataFrame:
        """Seconds and memory of the selection by number of features, of screened ones (keeps; none: by rule), order and
        number of groups, beside the number of groups there are; beyond 600 s it is labelled. Stages: see table("stages")."""
        done = self.done("runtime")
        for d in sizes or PROFILES[self.profile]["scaling"]:
            for f, k, m in itertools.product([screening_size(d, self.settings.screen) if f is None else min(f, d) for f in keeps], largest, most):

                def work(d=d, f=f, k=k, m=m):
                    data = synthetic.generate(self.spark, "main_effect", n, self.seed, noise=d - 4)
                    cost = audit.Audit(self.spark, f"runtime/{d}/{f}/{k}/{m}")
                    r = selector.fit(data.rows, data.d, self.settings.but(screen={"keep": f}, groups={"largest": k, "most": m}), audit=cost)
                    self.record("stages", [x.asDict() for x in cost.table().collect()])  # four rows
                    seconds = sum(x[2] for x in cost.found)
                    counts = {"n_groups": len(r.groups), "all_groups": sum(groups.group_counts(f, k).values()), "peak_worker_mb": max(x[-1] for x in cost.found)}
                    return [{"d": d, "keep": f, "largest": k, "most": m, "fs_seconds": seconds, "status": "TIMEOUT" if seconds > TIMEOUT else "OK", "n_selected": len(r.selected), **counts}]

                if (str(d), str(f), str(k), str(m)) not in done:
                    self.attempt("runtime", (d, f, k, m), work)
        return self.result("runtime")

    def budget_rows(self) -> DataFrame:
        """Rows of equal_budget at the square-root budget of each dataset, or at its largest where that was not run."""
        t = self.table("equal_budget")
        rule = F.greatest(F.lit(10), F.rint(F.sqrt("d"))).cast("int")
        have = t.groupBy("dataset").agg(F.max("budget").alias("_most"), F.bool_or(F.col("budget") == rule).alias("_has"), F.max(rule).alias("_rule"))
        return t.join(have, "dataset").filter(F.col("budget") == F.when(F.col("_has"), F.col("_rule")).otherwise(F.col("_most"))).drop("_most", "_has", "_rule")

    def statistics(self, reference: str = "canonical") -> dict[str, DataFrame]:
        """The four tables of the comparison at one budget."""
        return statistics.run_statistics(self.budget_rows().select("dataset", "run", "method", F.col("accuracy").alias("score")), reference)

    def accuracy_by_cardinality(self) -> DataFrame:
        """Summary of equal_budget by dataset, method and budget, with the frontier of few features and high accuracy."""
        s = reporting.summarize(self.table("equal_budget"), ["dataset", "method", "budget"], ["accuracy", "n_selected", "fs_seconds"])
        return reporting.pareto(s, "dataset", "n_selected_mean", "accuracy_mean")

    def export(self, folder: str) -> DataFrame:
        """Every table of results as CSV (lists joined by ";") and JSON below a folder; returns the manifest, which is written
        there too: section, rows, columns."""
        found = []
        for section in sorted(SECTIONS):
            t = self.table(section)
            if t is None:
                continue
            order = self.keys(section)
            flat = [F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in t.schema.fields]
            t.select(*flat).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/csv/{section}")  # results of units of work
            t.orderBy(*order).coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/json/{section}")
            found.append((section, t.count(), t.columns))
        manifest = self.spark.createDataFrame(found, "section string, rows long, columns array<string>")
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/manifest")
        return manifest

    def validate(self) -> dict[str, DataFrame]:
        """The checks of every table of results that there is; raises if any fails."""
        out = {}
        for section, keys in (("equal_budget", ("dataset", "method", "budget")), ("classifier_generality", ("dataset", "classifier")), ("ablation", ("dataset", "variant"))):
            t = self.table(section)
            if t is not None:
                t = t.filter("error is null")
                out[section] = reporting.run_validations(t, reporting.summarize(t, list(keys), ["accuracy"]), keys)
                reporting.assert_ok(out[section])
        return out

    def variant_stability(self) -> DataFrame | None:
        """dataset, variant, and the stability over runs of each ablation's selections."""
        t, out = self.table("ablation").filter(F.size("selected") > 0), None
        for r in t.groupBy("dataset", "variant").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dataset", "variant").collect():  # a row for each variant
            s = stability.summary(t.filter((F.col("dataset") == r["dataset"]) & (F.col("variant") == r["variant"])).select("run", "selected"), r["d"])
            s = s.select(F.lit(r["dataset"]).alias("dataset"), F.lit(r["variant"]).alias("variant"), *s.columns)
            out = s if out is None else out.unionByName(s)
        return out
