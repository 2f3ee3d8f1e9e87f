"""Run batches under their mappings and heal the mappings on drift.

Batches of a source depend on each other only through the mapping in force,
and whether a batch drifts under a mapping, and what can be inferred from it,
depends on the batch alone. So nothing is replayed batch by batch; a fixed
number of jobs does it, however many batches drift or are given up:

1. ``signatures``: one aggregate gives each batch its counts and its layout.
   Batches of one layout in a row are a *run*; a mapping that serves its first
   batch serves all of it.
2. Inference, for the first batches of all runs at once, both as a cold start
   and as a repair with its retries. Where that may fail, the other batches of
   the run follow, again all at once.
3. One ordered pass over the runs composes the mapping in force per source,
   with its events, from these results.
4. Rows find their mapping by a range join with the segments of that pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from contactlake import model, vocab
from contactlake.operators import drift, inference, mappings as M
from contactlake.operators.profiling import profile_source
from contactlake.operators.projection import FieldMapping, canonicalize
from contactlake.operators.records import payload_of
from contactlake.session import Scratch

#: what a proposal is for: a batch, taken as a cold start or as one that drifted
BATCH = ("source", "batch_id")
KEYS = (*BATCH, "mode")
COLD, HEAL = "cold", "heal"

#: ``mapper(profile, memory, attempt, feedback, keys)`` gives a mapping table keyed by ``keys``. ``feedback`` has
#: the rows (keys, report, failed) of batches that drifted or whose last proposal failed; ``failed`` lists the
#: (field, transform) pairs that did not serve, a null transform meaning any. A mapper with a true attribute
#: ``repeats`` gives the same proposals to the same feedback, the later attempts' among those of the first
Mapper = Callable[..., DataFrame]
FEEDBACK = "report string, failed array<struct<field:string,transform:string>>"

#: per batch what its attempts gave
OUTCOMES = (
    "source string, batch_id bigint, outcome array<struct<mode:string,attempt:int,"
    "mapping:array<struct<ordinal:int,field:string,transform:string>>,reason:string,drifted:boolean,report:string>>"
)

#: a block of batches that finds its segments together
BLOCK_BITS = 10
#: (segment, block) pairs are broadcast up to so many
MAX_BROADCAST_SEGMENTS = 100_000


@dataclass
class Healed:
    """Leads and review rows, and how they came about.

    ``events`` has the rows (source, batch_id, step, event, attempt, detail,
    mapping), ``segments`` (source, first, upto, mapping, reason) with ``upto``
    not included and a null mapping for review; ``mappings`` are those in force
    at the end; ``profiles`` those of the batches that were inferred from;
    ``checked`` the rows that a mapping served, with their violations.
    """

    leads: DataFrame
    review: DataFrame
    events: DataFrame
    segments: DataFrame
    mappings: dict[str, FieldMapping | None]
    profiles: DataFrame
    checked: DataFrame

    def event_rows(self, ts: Column) -> DataFrame:
        return model.heal_events(self.events.select("source", "event", "attempt", "detail"), ts)

    @property
    def learned(self) -> DataFrame:
        """(source, batch_id, step, mapping) of every approved mapping."""
        return self.events.filter("mapping IS NOT NULL").select(*BATCH, "step", "mapping")


def as_text(mapping: FieldMapping) -> str:
    """A mapping in its order, as JSON pairs."""
    return json.dumps(list(mapping.items()), ensure_ascii=False)


def as_mapping(text: str | None) -> dict[str, str] | None:
    return None if text is None else dict(json.loads(text))


def _pairs(mapping) -> dict[str, str]:
    return {p["field"]: p["transform"] for p in mapping}


class _Inference:
    """Proposals for all given batches at once, as a cold start and as a repair."""

    def __init__(self, mapper: Mapper, memory: DataFrame | None, max_attempts: int, sources: tuple[str, ...], scratch: Scratch):
        self.mapper, self.memory, self.max_attempts = mapper, memory, max_attempts
        self.sources, self.scratch = sources, scratch
        self.writes = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.writes += 1
        return self.scratch.put(f"inferred-{self.writes}", df)

    def infer(self, todo: DataFrame, attempt: int, feedback: DataFrame) -> DataFrame:
        """``(keys, reason, mapping)``; the mapper may try several times, asking for less each time."""
        found = []
        for turn in range(vocab.INFERENCE_ATTEMPTS):
            proposal = self.mapper(todo, self.memory, attempt + turn, feedback, KEYS)
            answer = self.put(M.judge_proposals(proposal, todo, KEYS))
            found.append(answer.filter("reason IS NULL"))
            rejected = answer.filter("reason IS NOT NULL")
            if turn == vocab.INFERENCE_ATTEMPTS - 1 or rejected.isEmpty():
                found.append(rejected)
                break
            again = rejected.select(*KEYS)
            todo = todo.join(again, list(KEYS), "left_semi")
            told = rejected.select(*KEYS, F.col("reason").alias("report"))
            feedback = feedback.drop("report").join(told, list(KEYS), "right").select(*KEYS, "report", "failed")
        return reduce(DataFrame.unionByName, found)

    def judged(self, answer: DataFrame, signatures: DataFrame) -> DataFrame:
        """With what each accepted mapping does on its own batch: ``drifted``, its report and the failed pairs."""
        sources, struct = self.sources, f"drifted boolean, {FEEDBACK}"

        @F.pandas_udf(struct)
        def judge(
            source: pd.Series, n: pd.Series, fields: pd.Series, first_keys: pd.Series, mapping: pd.Series
        ) -> pd.DataFrame:
            rows = []
            for s, count, cells, first, pairs in zip(source, n, fields, first_keys, mapping):
                if pairs is None:
                    rows.append((None, None, None))
                    continue
                pairs = _pairs(pairs)
                present, late = ({c["field"]: int(c[k]) for c in cells} for k in ("present", "late"))
                verdict = drift.judge(pairs, int(count), present, late, s in sources)
                created = [f for f, t in pairs.items() if t == "created_at"][-1:] if verdict.failed else []
                failed = [{"field": f, "transform": pairs[f]} for f in dict.fromkeys([*verdict.dead, *created])]
                text = drift.report_text(s, int(count), verdict, pairs, list(present), list(first if first is not None else ()), s in sources)
                rows.append((verdict.drifted, text, failed))
            return pd.DataFrame(rows, columns=["drifted", "report", "failed"])

        told = judge("source", "n", "fields", "first_keys", "mapping").alias("verdict")
        return answer.join(signatures.select(*BATCH, "n", "fields", "first_keys"), list(BATCH)).select(
            *KEYS, "reason", "mapping", told
        ).select(*KEYS, "reason", "mapping", "verdict.*")

    def outcomes(self, profile: DataFrame, signatures: DataFrame) -> DataFrame:
        """Per batch ``outcome``: its attempts (mode, attempt, mapping, reason, drifted, report).

        A repair starts from what the batch shows: fields that it hardly has
        cannot serve. Every failed attempt adds its pairs.
        """
        modes = F.explode(F.array(F.lit(COLD), F.lit(HEAL))).alias("mode")
        # the memory is searched once for all attempts
        profile = self.put(inference.with_remembered(profile, self.memory, BATCH).select("*", modes))
        batches = profile.select(*KEYS).distinct()
        missing = (F.col("n") - F.col("present")) / F.col("n") > vocab.MISSING_THRESHOLD
        gone = profile.groupBy(*KEYS).agg(
            F.collect_list(F.when(missing, F.struct("field", F.lit(None).cast("string").alias("transform")))).alias("failed")
        )
        feedback = self.put(
            gone.select(*KEYS, F.lit("fields hardly found in the data").alias("report"), "failed").filter(F.col("mode") == HEAL)
        )
        todo, tried = profile, []
        for attempt in range(1, self.max_attempts + 1):
            answer = self.put(self.judged(self.infer(todo, attempt, feedback), signatures))
            tried.append(answer.withColumn("attempt", F.lit(attempt)))
            open_ = answer.filter((F.col("mode") == HEAL) & (F.col("reason").isNotNull() | F.col("drifted")))
            if getattr(self.mapper, "repeats", False):
                # a batch whose proposals were all rejected would get the same ones again
                stuck = open_.filter("reason IS NOT NULL")
                tried += [stuck.withColumn("attempt", F.lit(n)) for n in range(attempt + 1, self.max_attempts + 1)]
                open_ = open_.filter("reason IS NULL")
            if attempt == self.max_attempts or open_.isEmpty():
                break
            todo = todo.join(open_.select(*KEYS), list(KEYS), "left_semi")
            new = open_.select(*KEYS, F.coalesce("reason", "report").alias("report"), F.col("failed").alias("_new"))
            before = feedback.drop("report")
            nothing = F.array().cast("array<struct<field:string,transform:string>>")
            feedback = self.put(
                new.join(before, list(KEYS), "left").select(
                    *KEYS, "report", F.concat(F.coalesce("failed", nothing), F.coalesce("_new", nothing)).alias("failed")
                )
            )
        every = reduce(DataFrame.unionByName, tried)
        step = F.struct("mode", "attempt", "mapping", "reason", "drifted", "report")
        done = every.groupBy(*BATCH).agg(F.collect_list(step).alias("outcome"))
        return self.put(batches.select(*BATCH).distinct().join(done, list(BATCH), "left"))


def _runs(signatures: DataFrame, known: Mapping[str, FieldMapping], sources: tuple[str, ...]) -> DataFrame:
    """Batches with the first batch of their run, and whether the known mapping may be out of force by then.

    A batch that one field could fail by its values is a run of its own. The
    window moves a few numbers per batch, not rows.
    """
    known = {s: dict(m) for s, m in known.items()}

    @F.pandas_udf("boolean")
    def drifts(source: pd.Series, n: pd.Series, fields: pd.Series) -> pd.Series:
        out = []
        for s, count, cells in zip(source, n, fields):
            present, late = ({c["field"]: int(c[k]) for c in cells} for k in ("present", "late"))
            out.append(s not in known or drift.judge(known[s], int(count), present, late, s in sources).drifted)
        return pd.Series(out, dtype="bool")

    by_batch = Window.partitionBy("source").orderBy("batch_id")
    before = F.lag(F.struct("layout", "late")).over(by_batch)
    head = before.isNull() | (before["layout"] != F.col("layout")) | F.col("late") | before["late"]
    marked = signatures.select(
        *BATCH, drifts("source", "n", "fields").alias("drifts"), F.col("layout"), F.col("late")
    ).select(*BATCH, "drifts", head.alias("head"))
    so_far = by_batch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.select(
        *BATCH, "head", F.max(F.when(F.col("head"), F.col("batch_id"))).over(so_far).alias("run"),
        F.max("drifts").over(so_far).alias("unsettled"),
    )


def _composed(
    rows: Iterator[dict], known: Mapping[str, FieldMapping], sources: tuple[str, ...], max_attempts: int
) -> Iterator[tuple]:
    """The ordered pass: (kind, source, batch_id, step, event, attempt, detail, mapping).

    Kinds are events, starts of segments and, at the end of a source, the
    mapping in force. Rows come by source and batch; of a run only the first
    batch, and the others where inference may fail.
    """
    source, mapping, shown = None, None, None
    for row in rows:
        if row["source"] != source:
            if source is not None:
                yield "end", source, None, None, None, None, None, mapping and as_text(mapping)
            source = row["source"]
            mapping, shown = known.get(source), object()
        elif not row["head"] and mapping is not None:
            continue  # what served the first batch of the run serves this one
        at, n = row["batch_id"], row["n"]
        fields = [c["field"] for c in row["fields"]]
        present, late = ({c["field"]: c[k] for c in row["fields"]} for k in ("present", "late"))
        outcome = {(o["mode"], o["attempt"]): o for o in row["outcome"] or ()}
        told, reason = [], None

        def event(name: str, attempt: int, detail: str, learned: FieldMapping | None = None) -> None:
            told.append(("event", source, at, len(told), name, attempt, detail, learned and as_text(learned)))

        if mapping is None:
            cold = outcome[COLD, 1]
            if cold["mapping"]:
                mapping = _pairs(cold["mapping"])
                event("mapping_learned", 0, str(mapping), mapping)
            else:
                reason = f"cold-start mapping failed: {cold['reason'] or M.NO_MAPPING}"
        if mapping is not None:
            verdict = drift.judge(mapping, n, present, late, source in sources)
            if verdict.drifted:
                report = drift.report_text(source, n, verdict, mapping, fields, row["first_keys"] or [], source in sources)
                event("drift_detected", 0, report)
                mapping = None
                for attempt in range(1, max_attempts + 1):
                    tried = outcome[HEAL, attempt]
                    event("retry", attempt, "")
                    report = tried["reason"] or tried["report"]
                    if tried["mapping"] and not tried["drifted"]:
                        mapping = _pairs(tried["mapping"])
                        event("healed", attempt, str(mapping), mapping)
                        break
                else:
                    reason = f"unhealed after {max_attempts} attempts: {report}"
        if mapping is None:
            event("human_review", 0, reason)
        yield from told
        if mapping is None or mapping != shown:
            yield "segment", source, at, None, None, None, reason, mapping and as_text(mapping)
            shown = mapping
    if source is not None:
        yield "end", source, None, None, None, None, None, mapping and as_text(mapping)


_LOG = "kind string, source string, batch_id bigint, step int, event string, attempt int, detail string, mapping string"


def _compose(
    items: DataFrame, known: Mapping[str, FieldMapping], sources: tuple[str, ...], max_attempts: int
) -> DataFrame:
    """``_composed`` as a job: the runs of a source stream through one task, in order."""
    known = {s: dict(m) for s, m in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
        names = [part.split()[0] for part in _LOG.split(", ")]
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

        for line in _composed(rows, known, sources, max_attempts):
            held.append(line)
            if len(held) == 1000:
                yield flush()
                held = []
        if held:
            yield flush()

    ordered = items.repartition("source").sortWithinPartitions("source", "batch_id")
    return ordered.mapInArrow(run, _LOG)


def _routed(df: DataFrame, segments: DataFrame, last: int) -> DataFrame:
    """Rows with ``_route`` and ``_reason`` of their segment: a range join by blocks of batches.

    Both are null for rows of no segment. The segments are broadcast if there
    are few; else Spark joins them by source and block.
    """
    block = "_block"
    binned = segments.select(
        "source", "first", "upto", F.md5("mapping").alias("_route"), F.col("reason").alias("_reason"),
        F.explode(
            F.sequence(
                F.shiftright("first", BLOCK_BITS), F.shiftright(F.coalesce(F.col("upto") - 1, F.lit(last)), BLOCK_BITS)
            )
        ).alias(block),
    )
    few = binned.count() <= MAX_BROADCAST_SEGMENTS
    s, r = (F.broadcast(binned) if few else binned).alias("s"), df.withColumn(block, F.shiftright("batch_id", BLOCK_BITS)).alias("r")
    inside = (
        (F.col("r.source") == F.col("s.source")) & (F.col(f"r.{block}") == F.col(f"s.{block}"))
        & (F.col("r.batch_id") >= F.col("s.first")) & (F.col("s.upto").isNull() | (F.col("r.batch_id") < F.col("s.upto")))
    )
    return r.join(s, inside, "left").select(*[F.col(f"r.{c}") for c in df.columns], "_route", "_reason")


def heal(
    df: DataFrame,
    known: Mapping[str, FieldMapping],
    ingest_ts: Column,
    mapper: Mapper = inference.infer_mapping,
    memory: DataFrame | None = None,
    max_attempts: int = vocab.MAX_HEAL_ATTEMPTS,
    order: str = "seq",
    sources: tuple[str, ...] = vocab.SOURCES,
    profile_rows: int | None = None,
    keep: tuple[str, ...] = (),
    identity: tuple[str, ...] = ("source", "seq", "raw_line"),
    scratch: Scratch | None = None,
) -> Healed:
    """Process batches ``(source, batch_id, batch_pos, rec, raw_line)`` as if in order.

    ``df`` is read a few times and should be a stored frame. Every row is routed
    by its batch: to the mapping that was in force for it, or to review, whole
    batches included. The checked rows are stored once, those that keep the
    contract apart from the others. ``sources`` are the names the contract
    accepts, ``keep`` further columns of the leads. An empty frame gives empty
    results; rows without a readable record go to review and do not count in
    their batch.
    """
    scratch = scratch or Scratch(df.sparkSession, "healing")
    readable = df.filter(F.col("rec").isNotNull())
    signatures = scratch.put("signatures", drift.signatures(readable))
    runs = scratch.put("runs", _runs(signatures, known, sources))
    job = _Inference(mapper, memory, max_attempts, sources, scratch)

    def learn(name: str, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Profiles and outcomes of batches."""
        rows = readable.join(batches.select(*BATCH), list(BATCH), "left_semi")
        profile = scratch.put(f"profiles-{name}", profile_source(rows, BATCH, order, profile_rows))
        return profile, job.outcomes(profile, signatures)

    asked = runs.filter("head AND unsettled")
    if asked.isEmpty():  # the known mappings serve everything
        profiles = profile_source(readable.limit(0), BATCH, order, profile_rows)
        outcomes = df.sparkSession.createDataFrame([], OUTCOMES)
    else:
        profiles, outcomes = learn("heads", asked)
    failing = F.exists("outcome", lambda o: o["reason"].isNotNull() & ((o["mode"] == COLD) | (o["attempt"] == max_attempts))) | F.exists(
        "outcome", lambda o: (o["attempt"] == max_attempts) & o["drifted"]
    )
    doubtful = outcomes.filter(failing).select("source", F.col("batch_id").alias("run"))
    others = scratch.put("others", runs.filter("NOT head").join(doubtful, ["source", "run"], "left_semi"))
    visited = runs.filter("head")
    if not others.isEmpty():
        more_profiles, more = learn("others", others)
        profiles, outcomes = profiles.unionByName(more_profiles), outcomes.unionByName(more)
        visited = visited.unionByName(others.select(*visited.columns))
    items = visited.join(signatures, list(BATCH)).join(outcomes, list(BATCH), "left").select(
        *BATCH, "head", "n", "fields", "first_keys", "outcome"
    )
    log = scratch.put("log", _compose(items, known, sources, max_attempts))
    ends = log.filter("kind = 'end'").select("source", "mapping").collect()  # one row per source
    upto = F.lead("batch_id").over(Window.partitionBy("source").orderBy("batch_id"))
    segments = scratch.put(
        "segments",
        log.filter("kind = 'segment'").select(
            "source", F.col("batch_id").alias("first"), upto.alias("upto"), "mapping", F.col("detail").alias("reason")
        ),
    )
    last = runs.agg(F.max("batch_id")).head()[0] or 0
    routed = _routed(df, segments, last)
    # the distinct mappings become literals of one plan
    used = segments.filter("mapping IS NOT NULL").select(F.md5("mapping").alias("route"), "mapping").distinct().collect()
    routes = {r.route: as_mapping(r.mapping) for r in sorted(used)}
    served = F.col("rec").isNotNull() & F.col("_route").isNotNull()
    checked = canonicalize(
        routed.filter(served), routes, ingest_ts, "_route", identity, keep=("batch_id", *keep), sources=sources
    ).drop("_route")
    stored = scratch.put("checked", checked.withColumn("valid", F.size("violations") == 0), ("valid",))
    leads = stored.filter("valid").drop("valid", "violations")
    failed = stored.filter("NOT valid").drop("valid")

    # unreadable records and those of batches that were given up, in one scan
    lost = F.col("rec").isNull()
    queued = routed.filter(lost | F.col("_route").isNull()).select(
        "source",
        F.when(lost, F.lit("unreadable record")).otherwise(F.col("_reason")).alias("reason"),
        F.when(lost, F.to_json(F.struct("raw_line"))).otherwise(payload_of(F.col("rec"))).alias("raw_payload"),
    )
    broken = failed.select(
        "source",
        F.concat(F.lit("row validation failed: "), F.array_join("violations", ", ")).alias("reason"),
        "raw_payload",
    )
    review = model.review_rows(queued.unionByName(broken), ingest_ts)
    events = log.filter("kind = 'event'").select(*BATCH, "step", "event", "attempt", "detail", "mapping")
    return Healed(leads, review, events, segments, {r.source: as_mapping(r.mapping) for r in ends}, profiles, stored)
