"""k-means of all cities, settings and restarts at once.

Vectors: (city, cell_id, v array<double>). Rows are put into chunks of a city once and never move then: a step is a
pass over them in which each task adds its rows up by (city, setting, restart, label), and tasks' sums are added;
only centroids go to the tasks. ``cluster_all`` seeds by
distance (k-means++) and iterates until labels stay; ``lloyd`` takes given centroids for a fixed number of steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import keep as write
from .order import places

SEED_STEP = 7919
#: Rows of a city that are one row of the numbered table, and whose distances are summed before a draw looks into them.
CHUNK = 1024
#: Differences that are squared at once.
AT_ONCE = 1 << 20
#: Bytes of centroids that go to the tasks at once; cities beyond are clustered after those before.
MOST_BYTES = 64 << 20


def square_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v)


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with label and squared distance d of the nearest centroid (city, label, c); the lower label wins ties."""
    c = centroids.groupBy("city").agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("all"))  # one row per city
    near = F.array_min(F.transform("all", lambda t: F.struct(square_distance(F.col("v"), t["c"]).alias("d"), t["label"].alias("label"))))
    return vectors.join(F.broadcast(c), "city").withColumn("near", near).select(*vectors.columns, F.col("near.label").alias("label"), F.col("near.d").alias("d"))


def update(assigned: DataFrame) -> DataFrame:
    """Mean vectors (city, label, c) of the labels: one row per dimension is summed before the shuffle."""
    x = assigned.select("city", "label", F.posexplode("v").alias("i", "x")).groupBy("city", "label", "i").agg(F.avg("x").alias("x"))
    return x.groupBy("city", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("c"))


def lloyd(vectors: DataFrame, centroids: DataFrame, steps: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A fixed number of steps; labels are those of the last assignment. ``keep`` may write the centroids of each
    step, a small table, so that a step doesn't derive those before it again."""
    for _ in range(steps):
        old = centroids.withColumnRenamed("c", "old")
        centroids = old.join(update(assign(vectors, centroids)), ["city", "label"], "left").select("city", "label", F.coalesce("c", "old").alias("c"))
        centroids = keep(centroids)
    return assign(vectors, centroids)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to each centroid; one centroid at a time, so nothing is larger than the rows."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def kmeans_array(x: np.ndarray, k: int, restarts: int = 12, max_iter: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centroids and inertia of one city's vectors in one array; the earlier restart wins ties. What
    ``cluster_all`` is held against."""
    n = len(x)
    k = min(k, n)
    best = (np.zeros(0, np.int32), x[:0], np.inf)
    for r in range(restarts if n else 0):
        rng = np.random.default_rng(seed + SEED_STEP * r)
        c = [x[int(rng.random() * n)]]
        d = np.full(n, np.inf)
        while len(c) < k:
            d = np.minimum(d, ((x - c[-1]) ** 2).sum(axis=1))
            run = np.cumsum(d)
            c.append(x[min(n - 1, int(np.searchsorted(run, rng.random() * run[-1])))])
        c = np.array(c)
        labels = np.full(n, -1)
        for it in range(max_iter):
            apart = distances(x, c)
            new = apart.argmin(axis=1)
            inertia = float(apart[np.arange(n), new].sum())
            same = bool((new == labels).all())
            labels = new
            if same and it > 0:
                break
            for j in range(k):
                mine = x[labels == j]
                c[j] = mine.mean(axis=0) if len(mine) else x[int(rng.random() * n)]
        if inertia < best[2]:
            best = (labels.astype(np.int32), c.copy(), inertia)
    return best


# ---- all cities, settings and restarts ----


@dataclass(frozen=True)
class Setting:
    param_id: int
    k: int
    seed: int = 42
    restarts: int = 12
    max_iter: int = 200


@dataclass
class Run:
    """One restart of a setting in a city."""

    city: object
    setting: Setting
    restart: int
    n: int
    rng: np.random.Generator
    centroids: np.ndarray | None = None
    marks: np.ndarray | None = None  # how many rows each label had in the step before, and their checksums
    inertia: float = np.inf
    steps: int = 0
    done: bool = False


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of each run's centroids c (runs, k, width) to each row: labels (rows, runs), the lower wins ties. One matrix
    product serves all runs; where it leaves two centroids too near to tell, distances are taken as ``distances`` does."""
    runs, k, width = c.shape
    flat = c.transpose(1, 0, 2).reshape(k * runs, width)
    apart = (flat * flat).sum(axis=1) - 2 * (x @ flat.T)
    label = np.zeros((len(x), runs), np.int64)
    best, second = apart[:, :runs].copy(), np.full((len(x), runs), np.inf)
    for j in range(1, k):
        d = apart[:, j * runs : (j + 1) * runs]
        label[d < best] = j
        second = np.minimum(second, np.maximum(d, best))
        best = np.minimum(best, d)
    least = 1e-11 * ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=2).max(axis=1))
    row, run = np.nonzero(~(second - best > least))
    some = max(1, AT_ONCE // (k * width))
    for i in range(0, len(row) if k > 1 else 0, some):
        p, q = row[i : i + some], run[i : i + some]
        label[p, q] = ((x[p, None, :] - c[q]) ** 2).sum(axis=2).argmin(axis=1)
    return label


def nearest_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows, runs) to the nearest of each run's centroids, as ``distances`` takes them."""
    label = nearest(x, c)
    return np.stack([((x - own[label[:, r]]) ** 2).sum(axis=1) for r, own in enumerate(c)], axis=1)


def marks_of(pos: np.ndarray) -> np.ndarray:
    """Three numbers of 20 bits for each place, whose sums are exact: labels have changed when they differ."""
    h = (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.stack([(h >> np.uint64(s)) & np.uint64(0xFFFFF) for s in (0, 20, 40)], axis=1).astype(float)


def number_rows(vectors: DataFrame, column: str) -> DataFrame:
    """(city, chunk, first, cell_ids, v): rows of a city numbered from 0 by cell_id, CHUNK of them in a row: the first one's
    number, and their vectors one behind the other."""
    x = places(vectors.select("city", "cell_id", F.col(column).alias("v")), ["city"], ["cell_id"])
    x = x.withColumn("chunk", F.expr(f"before div {CHUNK}")).groupBy("city", "chunk").agg(F.sort_array(F.collect_list(F.struct("before", "cell_id", "v"))).alias("own"))
    return write(x.select("city", "chunk", F.col("own")[0]["before"].alias("first"), F.col("own.cell_id").alias("cell_ids"), F.flatten("own.v").alias("v")), "rows")


class Rows:
    """Numbered rows of some cities, in the space of each setting: v itself, or v times the setting's loadings."""

    def __init__(self, rows: DataFrame, loadings: DataFrame | None):
        self.rows = rows
        self.spark = rows.sparkSession
        self.kind = rows.schema["city"].dataType.simpleString()
        self.tasks = rows.rdd.getNumPartitions()
        self.loadings = None
        if loadings is not None:  # of the cities taken at once; settings share spaces
            own: dict[tuple, int] = {}
            found: list[np.ndarray] = []
            self.number = {}
            for r in loadings.collect():
                m = np.array(r.loading)
                k = own.setdefault((r.city, m.shape, m.tobytes()), len(found))
                if k == len(found):
                    found.append(m)
                self.number[r.city, r.param_id] = k
            self.found = found
            self.loadings = self.spark.sparkContext.broadcast(found)

    def space(self, city: object, param_id: int, v: np.ndarray) -> np.ndarray:
        return v if self.loadings is None else v @ self.found[self.number[city, param_id]]

    def over(self, runs: list[Run], f: Callable, schema: str, rows: DataFrame | None = None, end: Callable | None = None) -> DataFrame:
        """f(task, group, x, centroids, keys, chunk: its city, number, first and cell_ids) of each chunk of rows and each of
        its city's groups of runs (of one setting, with as many centroids) as tables, ``end``(task) after a task's last;
        keys are places in ``runs``, task is a dict of the task's own."""
        groups: dict[tuple, list[int]] = {}
        for k, r in enumerate(runs):
            groups.setdefault((r.city, r.setting.param_id, len(r.centroids)), []).append(k)
        by_city: dict[object, list] = {}
        for g, ((city, param, _), keys) in enumerate(groups.items()):
            by_city.setdefault(city, []).append((g, None if self.loadings is None else self.number[city, param], np.array(keys), np.array([runs[k].centroids for k in keys])))
        sent, loads = self.spark.sparkContext.broadcast(by_city), self.loadings

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task: dict = {}
            for batch in batches:
                for i, city in enumerate(batch.column("city").to_pylist()):
                    cells = batch.column("cell_ids")[i].values
                    v = batch.column("v")[i].values.to_numpy().reshape(len(cells), -1)  # as long as the city's are
                    chunk = (city, batch.column("chunk")[i].as_py(), batch.column("first")[i].as_py(), cells)
                    spaces = {}
                    for g, space, keys, c in sent.value.get(city, ()):
                        if space not in spaces:
                            spaces[space] = v if loads is None else v @ loads.value[space]
                        yield from f(task, g, spaces[space], c, keys, chunk) or ()
            if end is not None:
                yield from end(task)

        return (self.rows if rows is None else rows).mapInArrow(go, schema)

    def chunks(self, wanted: dict[tuple[object, int], None]) -> DataFrame:
        """Some chunks (city, chunk)."""
        some = self.spark.createDataFrame(list(wanted), f"city {self.kind}, chunk long")  # a chunk a run at most
        return self.rows.join(F.broadcast(some), ["city", "chunk"], "left_semi")

    def at(self, wanted: dict[tuple[object, int], None]) -> dict[tuple[object, int], np.ndarray]:
        """The vectors at some places (city, pos)."""
        if not wanted:
            return {}
        own: dict[tuple[object, int], list[int]] = {}
        for city, pos in wanted:
            own.setdefault((city, pos // CHUNK), []).append(pos)
        sent = self.spark.sparkContext.broadcast(own)

        def pick(batches):
            for batch in batches:
                for i, key in enumerate(zip(batch.column("city").to_pylist(), batch.column("chunk").to_pylist(), strict=True)):
                    some = sent.value[key]
                    v = batch.column("v")[i].values.to_numpy().reshape(len(batch.column("cell_ids")[i]), -1)
                    v = v[np.array(some) - batch.column("first")[i].as_py()]
                    yield pa.RecordBatch.from_arrays([batch.column("city").take(pa.array([i] * len(some))), pa.array(some, pa.int64()), pa.array(list(v), pa.list_(pa.float64()))], names=["city", "pos", "v"])

        found = self.chunks(dict.fromkeys(own)).mapInArrow(pick, f"city {self.kind}, pos long, v array<double>")
        return {(r.city, r.pos): np.array(r.v) for r in found.collect()}  # a row for each draw


def draw_any(rows: Rows, runs: list[Run]) -> list[np.ndarray]:
    """A row for each run, all alike likely."""
    places = [(r.city, min(r.n - 1, int(r.rng.random() * r.n))) for r in runs]
    found = rows.at(dict.fromkeys(places))
    return [rows.space(r.city, r.setting.param_id, found[p][None, :])[0] for r, p in zip(runs, places, strict=True)]


def draw_far(rows: Rows, runs: list[Run]) -> list[np.ndarray]:
    """A row for each run, as likely as its squared distance to the nearest centroid so far is large: distances are summed
    by chunk, the chunk in which the running sum reaches the draw is found by prefix sums, and the row in that chunk by
    the task that reads it."""

    def sums(task, g, x, c, keys, chunk):
        yield pa.RecordBatch.from_pydict({"run": keys, "chunk": np.full(len(keys), chunk[1]), "s": np.cumsum(nearest_distances(x, c), axis=0)[-1]})

    draws = F.broadcast(rows.spark.createDataFrame([(k, r.rng.random()) for k, r in enumerate(runs)], "run long, u double"))  # a row a run
    chunks = rows.over(runs, sums, "run long, chunk long, s double")
    by, whole = Window.partitionBy("run").orderBy("chunk"), Window.partitionBy("run")
    x = chunks.withColumns({"until": F.sum("s").over(by), "total": F.sum("s").over(whole), "last": F.max("chunk").over(whole)}).join(draws, "run")
    hit = x.filter("until >= u * total or chunk = last").groupBy("run").agg(F.min(F.struct("chunk", F.expr("u * total - (until - s)").alias("rest"))).alias("h"))
    found = {h.run: (h.chunk, h.rest) for h in hit.select("run", "h.chunk", "h.rest").collect()}

    def distant(task, g, x, c, keys, chunk):
        mine = np.flatnonzero([found[k][0] == chunk[1] for k in keys.tolist()])
        if len(mine):
            until = np.cumsum(nearest_distances(x, c[mine]), axis=0)
            at = [min(len(x) - 1, int(np.searchsorted(until[:, i], found[k][1]))) for i, k in enumerate(keys[mine].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys[mine]), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["run", "x"])

    near = rows.chunks(dict.fromkeys((runs[k].city, c) for k, (c, _) in found.items()))
    chosen = {r.run: np.array(r.x) for r in rows.over(runs, distant, "run long, x array<double>", near).collect()}
    return [chosen[k] for k in range(len(runs))]


def step(rows: Rows, runs: list[Run]) -> None:
    """One assignment and update of every run. A run is done when no label has changed, not before its second step, or
    after as many steps as it may take. A task adds its rows up, so what it leaves doesn't grow with them."""

    def partial(task, g, x, c, keys, chunk):
        k = c.shape[1]
        own = (nearest(x, c)[:, :, None] == np.arange(k)).reshape(len(x), -1).astype(float)
        total = own.T @ np.hstack([x, np.ones((len(x), 1)), marks_of(chunk[2] + np.arange(len(x)))])
        task[g] = (keys, task[g][1] + total if g in task else total)

    def left(task):
        for g, (keys, total) in task.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([keys.tolist()]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g", "keys", "t"])

    def add(tables):
        return pa.table({"g": tables.column("g").slice(0, 1), "keys": tables.column("keys").slice(0, 1), "t": pa.array([np.stack([t.values.to_numpy() for t in tables.column("t")]).sum(axis=0)], pa.list_(pa.float64()))})

    x = rows.over(runs, partial, "g long, keys array<long>, t array<double>", end=left)
    if rows.tasks * sum(8 * r.centroids.size for r in runs) > MOST_BYTES:  # else the driver adds tasks' sums as they are
        x = x.groupBy("g").applyInArrow(add, "g long, keys array<long>, t array<double>")
    sums: dict[int, tuple] = {}
    for f in x.toArrow().to_batches():  # a row for each city and setting
        for g, keys, t in zip(f.column("g").to_pylist(), f.column("keys"), f.column("t"), strict=True):
            t = t.values.to_numpy()
            sums[g] = (keys.as_py(), t + sums[g][1] if g in sums else t)
    for keys, t in sums.values():
        k, width = runs[keys[0]].centroids.shape
        for key, own in zip(keys, t.reshape(len(keys), k, width + 4), strict=True):
            advance(runs[key], own)
    empty = [(r, j) for r in runs if not r.done for j in np.flatnonzero(r.marks[:, 0] == 0)]
    for (r, j), x in zip(empty, draw_any(rows, [r for r, _ in empty]), strict=True):
        r.centroids[j] = x


def advance(run: Run, total: np.ndarray) -> None:
    """Centroids of the next step from sums of rows, numbers and marks by label; those without rows are to be drawn."""
    before, run.marks = run.marks, total[:, -4:].copy()
    run.steps += 1
    run.done = run.steps > 1 and bool((run.marks == before).all()) or run.steps >= run.setting.max_iter
    if not run.done:
        with np.errstate(divide="ignore", invalid="ignore"):
            run.centroids = total[:, :-4] / total[:, -4:-3]


def inertias(rows: Rows, runs: list[Run]) -> None:
    """Sums of squared distances, once runs are done."""

    def partial(task, g, x, c, keys, chunk):
        task[g] = (keys, nearest_distances(x, c).sum(axis=0) + (task[g][1] if g in task else 0.0))

    def left(task):
        for keys, s in task.values():
            yield pa.RecordBatch.from_pydict({"run": keys, "s": s})

    for r in rows.over(runs, partial, "run long, s double", end=left).groupBy("run").agg(F.sum("s").alias("s")).collect():  # a row a run
        runs[r.run].inertia = r.s


def cluster_all(vectors: DataFrame, settings: list[Setting], column: str = "v", loadings: DataFrame | None = None) -> DataFrame:
    """(city, param_id, cell_id, label, inertia) for every city and setting. loadings: (city, param_id, loading: a row of
    numbers for each entry of v), in whose space a setting clusters; rows aren't copied for it.

    All restarts of all settings and cities go through the rows together, as many cities at once as MOST_BYTES of
    centroids and loadings allow; runs that are done take no further part."""
    table = number_rows(vectors, column)
    many = F.size("cell_ids")
    sizes = [(r.city, r.n, r.width) for r in table.groupBy("city").agg(F.sum(many).alias("n"), F.max((F.size("v") / many).cast("int")).alias("width")).collect()]  # a row a city
    groups: list[list] = []
    left = 0
    for city, n, width in sorted(sizes, key=lambda s: str(s[0])):
        need = 8 * width * (sum(2 * s.restarts * min(s.k, n) for s in settings) + (0 if loadings is None else width * len(settings)))
        if not groups or left < need:
            groups.append([])
            left = MOST_BYTES
        groups[-1].append((city, n))
        left -= need
    out = [cluster_some(table, some, settings, loadings, len(groups) > 1) for some in groups]
    if not out:
        return vectors.sparkSession.createDataFrame([], f"city {table.schema['city'].dataType.simpleString()}, param_id int, cell_id {vectors.schema['cell_id'].dataType.simpleString()}, label int, inertia double")
    while len(out) > 1:
        out = [a.union(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) - len(out) % 2 :]
    return out[0]


def cluster_some(table: DataFrame, cities: list[tuple[object, int]], settings: list[Setting], loadings: DataFrame | None, part: bool) -> DataFrame:
    mine = F.col("city").isin([c for c, _ in cities])
    rows = Rows(table.filter(mine), loadings if loadings is None else loadings.filter(mine)) if part else Rows(table, loadings)
    runs = [Run(c, s, r, n, np.random.default_rng(s.seed + SEED_STEP * r)) for c, n in cities for s in settings for r in range(s.restarts)]
    for r, x in zip(runs, draw_any(rows, runs), strict=True):
        r.centroids = x[None, :]
    while some := [r for r in runs if len(r.centroids) < min(r.setting.k, r.n)]:
        for r, x in zip(some, draw_far(rows, some), strict=True):
            r.centroids = np.concatenate([r.centroids, x[None, :]])
    while some := [r for r in runs if not r.done]:
        step(rows, some)
    inertias(rows, runs)
    best: dict[tuple[object, int], Run] = {}
    for r in runs:
        if (at := (r.city, r.setting.param_id)) not in best or r.inertia < best[at].inertia:
            best[at] = r

    chosen = list(best.values())
    params, found = [r.setting.param_id for r in chosen], [r.inertia for r in chosen]
    kind = to_arrow_type(table.schema["city"].dataType)

    def label(task, g, x, c, keys, chunk):
        city, _, _, cells = chunk
        for k, near in zip(keys.tolist(), nearest(x, c).T.astype(np.int32), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([city] * len(near), kind), pa.array(np.full(len(near), params[k], np.int32)), cells, pa.array(near), pa.array(np.full(len(near), found[k]))], names=["city", "param_id", "cell_id", "label", "inertia"])

    cell = table.schema["cell_ids"].dataType.elementType.simpleString()
    return rows.over(chosen, label, f"city {rows.kind}, param_id int, cell_id {cell}, label int, inertia double")
