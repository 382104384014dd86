"""Closed-loop replay of replacement policies whose state has no relational form.

Runs (trace, capacity, policy, seed) are rows of a plan; each is one group of requests. A run that fails gives a row with
its error. Policies follow their published descriptions.
"""

from __future__ import annotations

import random
from collections import OrderedDict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachesight.operators.trace import decisions, lru_replay
from cachesight.sources.shared import materialize

DETERMINISTIC = ["lru", "mru", "fifo", "lfu", "sieve", "arc", "s3fifo"]


class Recency:
    """Least or most recently used, or first in."""

    def __init__(self, capacity: int, last: bool = False, touch: bool = True):
        self.capacity, self.last, self.touch, self.held = capacity, last, touch, OrderedDict()

    def request(self, x: str) -> tuple[bool, bool]:
        if x in self.held:
            if self.touch:
                self.held.move_to_end(x)
            return True, False
        full = len(self.held) >= self.capacity
        if full:
            self.held.popitem(last=self.last)
        self.held[x] = True
        return False, full


class Random:
    def __init__(self, capacity: int, seed: int):
        self.capacity, self.rng, self.order, self.place = capacity, random.Random(seed), [], {}

    def request(self, x: str) -> tuple[bool, bool]:
        if x in self.place:
            return True, False
        full = len(self.order) >= self.capacity
        if full:
            k = self.rng.randrange(len(self.order))
            del self.place[self.order[k]]
            self.order[k] = x
            self.place[x] = k
        else:
            self.place[x] = len(self.order)
            self.order.append(x)
        return False, full


class Frequency:
    """Least frequently used since admission; ties go to the least recent."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.groups = capacity, {}, {}

    def request(self, x: str) -> tuple[bool, bool]:
        if x in self.count:
            n = self.count[x]
            del self.groups[n][x]
            self.count[x] = n + 1
            self.groups.setdefault(n + 1, OrderedDict())[x] = True
            return True, False
        full = len(self.count) >= self.capacity
        if full:
            n = min(k for k, g in self.groups.items() if g)
            old, _ = self.groups[n].popitem(last=False)
            del self.count[old]
        self.count[x] = 1
        self.groups.setdefault(1, OrderedDict())[x] = True
        return False, full


class Sieve:
    """A queue with visited marks and a hand that moves from the oldest to the newest and never back."""

    def __init__(self, capacity: int):
        self.capacity, self.visited, self.newer, self.older = capacity, {}, {}, {}
        self.head = self.tail = self.hand = None

    def request(self, x: str) -> tuple[bool, bool]:
        if x in self.visited:
            self.visited[x] = True
            return True, False
        full = len(self.visited) >= self.capacity
        if full:
            h = self.hand if self.hand is not None else self.tail
            while self.visited[h]:
                self.visited[h] = False
                h = self.newer[h] if self.newer[h] is not None else self.tail
            self.hand = self.newer[h]
            n, o = self.newer.pop(h), self.older.pop(h)
            if n is not None:
                self.older[n] = o
            else:
                self.head = o
            if o is not None:
                self.newer[o] = n
            else:
                self.tail = n
            del self.visited[h]
        self.visited[x], self.newer[x], self.older[x] = False, None, self.head
        if self.head is not None:
            self.newer[self.head] = x
        self.head = x
        if self.tail is None:
            self.tail = x
        return False, full


class Arc:
    """Two lists of recent and frequent items, their ghosts, and a target size that ghost hits move."""

    def __init__(self, capacity: int):
        self.c, self.p = capacity, 0.0
        self.recent, self.frequent, self.gone_recent, self.gone_frequent = (OrderedDict() for _ in range(4))

    def _replace(self, in_gone_frequent: bool) -> bool:
        if self.recent and (len(self.recent) > self.p or in_gone_frequent and len(self.recent) == self.p):
            x, _ = self.recent.popitem(last=False)
            self.gone_recent[x] = True
        elif self.frequent:
            x, _ = self.frequent.popitem(last=False)
            self.gone_frequent[x] = True
        else:
            return False
        return True

    def request(self, x: str) -> tuple[bool, bool]:
        if x in self.recent or x in self.frequent:
            self.recent.pop(x, None)
            self.frequent.pop(x, None)
            self.frequent[x] = True
            return True, False
        full = len(self.recent) + len(self.frequent) >= self.c
        if x in self.gone_recent:
            self.p = min(self.c, self.p + max(len(self.gone_frequent) / len(self.gone_recent), 1))
            out = self._replace(False) if full else False
            del self.gone_recent[x]
            self.frequent[x] = True
            return False, out
        if x in self.gone_frequent:
            self.p = max(0.0, self.p - max(len(self.gone_recent) / len(self.gone_frequent), 1))
            out = self._replace(True) if full else False
            del self.gone_frequent[x]
            self.frequent[x] = True
            return False, out
        out = False
        if len(self.recent) + len(self.gone_recent) == self.c:
            if len(self.recent) < self.c:
                self.gone_recent.popitem(last=False)
                out = self._replace(False) if full else False
            else:
                self.recent.popitem(last=False)
                out = True
        elif full:
            if len(self.recent) + len(self.frequent) + len(self.gone_recent) + len(self.gone_frequent) >= 2 * self.c:
                self.gone_frequent.popitem(last=False)
            out = self._replace(False)
        self.recent[x] = True
        return False, out


class S3Fifo:
    """A small queue of a tenth, a main queue, and a ghost queue; items asked for twice leave the small for the main queue."""

    def __init__(self, capacity: int, small: float = 0.1, ghost: float = 0.9, promote: int = 2):
        self.c, self.small_size, self.ghost_size, self.promote = capacity, max(1, int(capacity * small)), max(1, int(capacity * ghost)), promote
        self.small, self.main, self.ghost, self.freq = deque(), deque(), OrderedDict(), {}

    def _evict(self) -> None:
        while True:
            if self.small and (len(self.small) >= self.small_size or not self.main):
                x = self.small.popleft()
                if self.freq[x] >= self.promote:
                    self.freq[x] = 0
                    self.main.append(x)
                    continue
                del self.freq[x]
                self.ghost[x] = True
                if len(self.ghost) > self.ghost_size:
                    self.ghost.popitem(last=False)
                return
            x = self.main.popleft()
            if self.freq[x] > 0:
                self.freq[x] -= 1
                self.main.append(x)
                continue
            del self.freq[x]
            return

    def request(self, x: str) -> tuple[bool, bool]:
        if x in self.freq:
            self.freq[x] = min(self.freq[x] + 1, 3)
            return True, False
        full = len(self.freq) >= self.c
        if full:
            self._evict()
        self.freq[x] = 0
        if self.ghost.pop(x, None):
            self.main.append(x)
        else:
            self.small.append(x)
        return False, full


def policy(name: str, capacity: int, seed: int = 0):
    make = {"lru": lambda: Recency(capacity), "mru": lambda: Recency(capacity, last=True), "fifo": lambda: Recency(capacity, touch=False), "lfu": lambda: Frequency(capacity), "sieve": lambda: Sieve(capacity), "arc": lambda: Arc(capacity), "s3fifo": lambda: S3Fifo(capacity), "random": lambda: Random(capacity, seed)}
    return make[name]()


def execution_plan(traces: DataFrame, capacities: list[int], policies: list[str], seeds: int) -> DataFrame:
    """A row for each run: each policy once, and the random one for each seed. Traces and capacities are few."""
    cells = traces.select("trace").distinct().select("trace", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])).alias("capacity"))
    runs = [F.struct(F.lit(p).alias("policy"), F.lit(0).alias("seed")) for p in policies if p != "random"]
    runs += [F.struct(F.lit("random").alias("policy"), F.lit(s).alias("seed")) for s in range(seeds)]
    return cells.select("trace", "capacity", F.explode(F.array(*runs)).alias("r")).select("trace", "capacity", "r.policy", "r.seed")


RUN = "trace string, capacity long, policy string, seed int, status string, requests long, hits long, misses long, evictions long, error string"


#: Requests of a row that runs read.
BLOCK = 256


class _Run:
    """A run as far as its requests have come."""

    def __init__(self, trace, capacity, name, seed):
        self.row, self.counts, self.error = (trace, capacity, name, seed), [0, 0, 0], None
        try:
            self.ask = policy(name, int(capacity), int(seed)).request
        except Exception as e:  # a failed run is a result
            self.error = f"{type(e).__name__}: {e}"

    def take(self, items: list, scored) -> None:
        if self.error:
            return
        n, hits, out = self.counts
        try:
            for item, counts in zip(items, scored):
                hit, evicted = self.ask(item)
                if counts:
                    n, hits, out = n + 1, hits + hit, out + evicted
        except Exception as e:
            self.error = f"{type(e).__name__}: {e}"
        self.counts = [n, hits, out]

    def result(self) -> tuple:
        n, hits, out = self.counts
        return (*self.row, "failed", None, None, None, None, self.error) if self.error else (*self.row, "complete", n, hits, n - hits, out, None)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of the runs whose blocks come in order; a task holds a batch of blocks and the state of one run."""
    names, run = [c.split()[0] for c in RUN.split(", ")], None
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({k: object for k in ("trace", "policy", "status", "error")}).astype({k: "Int64" for k in ("requests", "hits", "misses", "evictions")})
    for b in batches:
        done = []
        for trace, capacity, name, seed, items, scored in b[["trace", "capacity", "policy", "seed", "items", "scored"]].itertuples(index=False):
            if run is None or run.row != (trace, capacity, name, seed):
                if run:
                    done.append(run.result())
                run = _Run(trace, capacity, name, seed)
            run.take(items.tolist(), scored.tolist())
        if done:
            yield frame(done)
    if run:
        yield frame([run.result()])


def simulate(traces: DataFrame, plan: DataFrame) -> DataFrame:
    """A result row for each run of ``plan``. ``traces`` may have a boolean column scored; without it all requests count.

    Requests are gathered in blocks of time, which go to each run and are read in their order. Runs are dealt out; a run's requests
    are one after the other, as its state is, but never in memory together. Results are a table, a row for each run, so what reads
    them often does not run them again.
    """
    t = traces if "scored" in traces.columns else traces.withColumn("scored", F.lit(True))
    request = F.collect_list(F.struct("t", "item", "scored"))
    blocks = t.groupBy("trace", F.floor(F.col("t") / BLOCK).alias("block")).agg(F.sort_array(request).alias("r"))
    blocks = blocks.select("trace", "block", F.transform("r", lambda x: x["item"]).alias("items"), F.transform("r", lambda x: x["scored"]).alias("scored"))
    key = ["trace", "capacity", "policy", "seed"]
    run = plan.select(*key).distinct()  # blocks of a run that is planned twice would mix
    n = min(max(1, run.count()), MOST_TASKS)
    rows = blocks.join(run, "trace").repartition(n, *key).sortWithinPartitions(*key, "block")
    return materialize(rows.mapInPandas(_runs, RUN), "runs")


#: Tasks that runs are dealt to, at most.
MOST_TASKS = 2000


def policy_summary(runs: DataFrame) -> DataFrame:
    """Against the least-recently-used policy of the same cell: absolute and relative differences of misses."""
    base = F.max(F.when(F.col("policy") == "lru", F.col("misses"))).over(Window.partitionBy("trace", "capacity"))
    r = runs.where("status = 'complete'").withColumn("lru", base)
    return r.groupBy("trace", "capacity", "policy").agg(F.count("*").alias("runs"), F.round(F.avg("misses"), 9).alias("mean_misses"), F.round(F.avg(F.col("misses") - F.col("lru")), 9).alias("difference"), F.round(F.avg(F.try_divide((F.col("misses") - F.col("lru")).cast("double"), F.col("lru").cast("double"))), 9).alias("relative_difference"))


def best_policy(summary: DataFrame) -> DataFrame:
    """Of each cell the policy of fewest misses (ties by name) and the spread between policies."""
    return summary.groupBy("trace", "capacity").agg(F.min_by("policy", F.struct("mean_misses", "policy")).alias("best"), F.round(F.max("mean_misses") - F.min("mean_misses"), 9).alias("spread"))


def run_gates(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """(gate, passed, detail) of a campaign."""
    key = ["trace", "capacity", "policy", "seed"]
    missing = plan.join(runs, key, "left_anti").agg(F.count("*").alias("n"))
    extra = runs.join(plan, key, "left_anti").agg(F.count("*").alias("n"))
    double = runs.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n"))
    own = runs.agg(F.count_if(F.col("status") != "complete").alias("failed"), F.count_if(F.col("hits") + F.col("misses") != F.col("requests")).alias("sums"), F.count_if(F.col("evictions") > F.col("misses")).alias("evictions"))
    name = lambda df, gate, c="n": df.select(F.lit(gate).alias("gate"), (F.col(c) == 0).alias("passed"), F.col(c).alias("faults"))
    parts = [name(missing, "all_runs_present"), name(extra, "no_unplanned_runs"), name(double, "no_double_runs"), name(own, "all_complete", "failed"), name(own, "hits_and_misses_sum", "sums"), name(own, "evictions_within_misses", "evictions")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


LOSSES = "trace string, capacity long, t long, page string, y_loss double"


def _random_losses(pages: np.ndarray, requests: np.ndarray, seeds: int, most: int = 1 << 16) -> np.ndarray:
    """Of decisions with as many pages and requests each, as numbers: for each page the mean misses over the seeds of ``Random``.

    All (decision, page, seed) go through their requests together. The n-th eviction of a seed takes the same place for all, as
    caches of one capacity draw from the same range.
    """
    n, c = pages.shape
    later = requests.shape[1] - 1
    draws = np.array([[r.randrange(c) for _ in range(later)] for r in map(random.Random, range(seeds))], np.int64).reshape(seeds, later)
    others = np.array([[k for k in range(c) if k != e] for e in range(c)], np.int64).reshape(c, c - 1)
    out = np.empty((n, c))
    step = max(1, most // (c * seeds))
    for at in range(0, n, step):
        own, asked = pages[at : at + step], requests[at : at + step]
        m = len(own)
        # the pages but one, and behind them the request that replaced it
        start = np.concatenate([own[:, others], np.broadcast_to(asked[:, None, :1], (m, c, 1))], axis=2)
        held = np.repeat(start[:, :, None, :], seeds, axis=2).reshape(-1, c)
        misses = np.zeros(len(held), np.int64)
        seed = np.tile(np.arange(seeds), m * c)
        for k in range(1, later + 1):
            x = np.repeat(asked[:, k], c * seeds)
            missed = np.flatnonzero(~(held == x[:, None]).any(axis=1))
            held[missed, draws[seed[missed], misses[missed]]] = x[missed]
            misses[missed] += 1
        out[at : at + step] = misses.reshape(m, c, seeds).sum(axis=2) / seeds
    return out


def _losses(batches: Iterator[pd.DataFrame], name: str, seeds: int) -> Iterator[pd.DataFrame]:
    """From a row for each decision with its pages, least recent first, and its requests, its own first: forced replacement of
    each page, then the policy ``name`` for the later requests."""
    for b in batches:
        if name == "random":
            yield from _random_batch(b, seeds)
            continue
        rows = []
        for trace, capacity, t, pages, requests in b[["trace", "capacity", "t", "pages", "requests"]].itertuples(index=False):
            pages, (x, *later) = list(pages), list(requests)
            for e in pages:
                own = policy(name, int(capacity))
                for r in [*(k for k in pages if k != e), x]:
                    own.request(r)
                rows.append((trace, capacity, t, e, float(sum(not own.request(r)[0] for r in later))))
        yield _typed(pd.DataFrame(rows, columns=[c.split()[0] for c in LOSSES.split(", ")]))


def _typed(out: pd.DataFrame) -> pd.DataFrame:
    return out.astype({"trace": object, "page": object, "capacity": "int64", "t": "int64", "y_loss": float})


def _random_batch(b: pd.DataFrame, seeds: int) -> Iterator[pd.DataFrame]:
    lengths = pd.Series(list(zip(b["pages"].map(len), b["requests"].map(len), strict=True)), index=b.index, dtype=object)
    for (c, k), own in b.groupby(lengths, sort=False):
        names = np.concatenate([np.concatenate(own["pages"].to_list()), np.concatenate(own["requests"].to_list())])
        codes = pd.factorize(names)[0]
        n = len(own)
        losses = _random_losses(codes[: n * c].reshape(n, c), codes[n * c :].reshape(n, k), seeds)
        repeat = lambda column: np.repeat(own[column].to_numpy(), c)
        yield _typed(pd.DataFrame({"trace": repeat("trace"), "capacity": repeat("capacity"), "t": repeat("t"), "page": names[: n * c], "y_loss": losses.ravel()}))


def continuation_losses(traces: DataFrame, capacities: list[int], name: str, horizon: int, seeds: int = 10) -> DataFrame:
    """Losses as of the rollout labels, but with ``name`` (mru, random, lru ...) as the continuation; the random policy uses
    the same seeds for each page and gives their mean. Each decision is a row with all that its rollouts need.

    Where no later request is for a page, the decision's own request or an earlier one of them, each is a miss whatever the policy;
    only the other decisions are replayed.
    """
    replay = materialize(lru_replay(traces, capacities), "continued")
    items = F.transform("next", lambda r: r["item"])
    own = F.transform(F.array_sort(F.transform("pages", lambda p: F.struct(p["last"].alias("last"), p["page"].alias("page")))), lambda p: p["page"])
    at = decisions(traces.select("trace", "t", "item"), replay, horizon).select("trace", "capacity", "t", F.col("own.item").alias("item"), own.alias("pages"), items.alias("later"))
    return _continued(at, name, seeds)


def _continued(at: DataFrame, name: str, seeds: int) -> DataFrame:
    at = at.withColumn("requests", F.concat(F.array("item"), "later"))
    again = F.arrays_overlap("pages", "later") | (F.size(F.array_distinct("requests")) < F.size("requests"))
    sure = at.where(~again).select("trace", "capacity", "t", F.explode("pages").alias("page"), F.size("later").cast("double").alias("y_loss"))
    return sure.unionByName(at.where(again).mapInPandas(lambda batches: _losses(batches, name, seeds), LOSSES))
