"""Resubmission of killed takes, a tick of the watch at a time.

What tables can tell is told by tables, for all kills of a tick at once: which
were never sent, what the stopping rules say, which jobs landed.  Only the
submissions themselves are made one by one, as each starts a job: at most as
many in a minute as the rate allows.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.kernels import mutated_seeds, seed_signature
from ..operators import breaker, ledger, lineage
from ..plans.session import cut
from ..sources import external, sidecars, sinks

JOB = "key string, driver string, job string, clip string, parent string, shot string, submitted string, state string"


class Resubmission:
    """The run's state (a file), its driver, and this process's own record of
    submissions: (time, shot, failed).  A restart gives a driver a new chance."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        command: str,
        state: str,
        want: dict[str, int] | None = None,
        rate: int = ledger.REGEN_RATE,
        fail_block: int = ledger.FAIL_BLOCK,
        dry_run: bool = False,
        now: Callable[[], float] = time.time,
    ) -> None:
        self.spark, self.root, self.state = spark, root, state
        self.driver = external.Driver(command)
        self.rate, self.fail_block, self.dry_run, self.now = rate, fail_block, dry_run, now
        self.record: list[tuple[float, str | None, bool]] = []
        self.doc = sinks.load_ledger(state)
        self.doc["want"] |= want or {}
        if not dry_run:
            self.recover()

    # ---- the run's state as tables

    def jobs(self) -> DataFrame:
        rows = [(k, j.get("driver"), j.get("job", k), j.get("clip"), j.get("parent"), j.get("shot"), j.get("submitted"), j.get("state")) for k, j in self.doc["jobs"].items()]
        return self.spark.createDataFrame(rows, JOB)

    def _save(self) -> None:
        if not self.dry_run:
            sinks.save_ledger(self.doc, self.state)

    def _landed(self) -> DataFrame:
        seen = sidecars.snapshot(self.spark, self.root).select(F.col("path").alias("clip"))
        # a job's clip may lie outside of the watched folder
        away = [(j["clip"],) for j in self.doc["jobs"].values() if j.get("clip") and os.path.exists(j["clip"])]
        return seen.union(self.spark.createDataFrame(away, "clip string")).distinct()

    def _takes(self) -> DataFrame:
        """One scan of the sidecars, for all that a tick asks of them."""
        docs = sidecars.find_takes(self.spark, self.root, permissive=True)
        return cut(sidecars.flat(docs).drop("doc"))

    # ---- at the start

    def recover(self) -> None:
        """Adopts jobs that only a stub knows, then settles all that are open:
        by what landed, else by what their driver says."""
        takes = self._takes()
        stubs = takes.where("job is not null").select("job", "clip", "parent", "shot", "driver", "submitted")
        for r in ledger.adopt(stubs, self.jobs()).collect():  # jobs of one run that a crash lost
            self.doc["jobs"][r["job"]] = {"driver": r["driver"], "job": r["job"], "clip": r["clip"], "parent": r["parent"], "shot": r["shot"], "submitted": r["submitted"], "state": "queued", "adopted": sinks.now()}
        open_ = self.jobs().where(~F.col("state").isin(*ledger.TERMINAL))
        landed = cut(self._landed())
        said = cut(external.polled(open_.join(landed, "clip", "left_anti")))
        states = ledger.reconcile(self.jobs(), landed, said).join(said.drop("state"), "key", "left")
        for r in states.collect():
            self._settle(r["key"], r["state"], r["error"], r["output"])
        self._save()

    def _settle(self, key: str, state: str, error: str | None = None, output: str | None = None) -> None:
        job = self.doc["jobs"][key]
        job |= {"state": state} | ({"error": error} if error and state == "error" else {})
        if state in ledger.TERMINAL:
            job["resolved"] = sinks.now()
            if state == "done" and output and output != job["clip"]:
                job["landed"] = output

    # ---- at each tick

    def gated(self, takes: DataFrame, candidates: DataFrame, landed: DataFrame) -> DataFrame:
        """(clip, shot, ok, why) of candidates (clip), by the stopping rules."""
        kills = takes.where("verdict = 'kill'").select("shot", F.explode("reasons").alias("reason"), seed_signature(F.col("seeds")).alias("signature"))
        want = self.spark.createDataFrame(list(self.doc["want"].items()), "shot string, want int")
        shots = cut(ledger.refresh(takes, self.jobs(), want, ledger.futility(kills), breaker.breaker_states(takes), self.doc["want_default"]))
        caps = self.doc["caps"]
        self.doc["shots"] = {r["shot"]: {k: v for k, v in r.asDict().items() if k != "shot"} for r in shots.collect()}  # a file's worth: it is published
        self.doc["attempts"], self.doc["spend_usd"] = len(self.doc["jobs"]), round(sum(s["spend_usd"] for s in self.doc["shots"].values()), 6)
        chains = lineage.chain_lengths(takes)
        gate = ledger.submit_gate(candidates, takes, shots, chains, caps.get("attempts"), caps.get("spend_usd"), caps.get("lineage") or lineage.LINEAGE_CAP)
        return gate.join(takes.select("clip", "shot", "take_id", "seeds"), "clip", "left")

    def _blocked(self) -> dict[str | None, int]:
        """Straight failures of each shot that has as many as block it."""
        runs: dict[str | None, int] = {}
        for _, shot, failed in self.record:
            runs[shot] = runs.get(shot, 0) + 1 if failed else 0
        return {shot: n for shot, n in runs.items() if n >= self.fail_block}

    def _room(self) -> int:
        since = self.now() - ledger.RATE_SECONDS
        return self.rate - sum(at >= since for at, _, _ in self.record)

    def act(self, candidates: DataFrame, takes: DataFrame, quiet: bool = False) -> list[dict]:
        """Events of the candidates (clip), in order; refusals only if not quiet."""
        landed = self._landed()
        open_ = self.jobs().where(~F.col("state").isin(*ledger.TERMINAL))
        for r in open_.join(landed, "clip", "left_semi").select("key").collect():
            self._settle(r["key"], "done")
        gate = cut(self.gated(takes, candidates, landed))
        events = []
        if not quiet:
            why = gate.where("not ok").orderBy("clip")
            events += [self._event(r["clip"], r["shot"], "skipped", reason=r["why"]) for r in why.toLocalIterator()]
        seeds = mutated_seeds(F.col("seeds"), F.coalesce("take_id", F.lit("")), F.lit(len(self.doc["jobs"]) + 1))
        cap = self.doc["caps"].get("attempts")
        for r in gate.where("ok").withColumn("new", seeds).orderBy("clip").toLocalIterator():
            blocked = self._blocked()
            if r["shot"] in blocked:
                event = self._event(r["clip"], r["shot"], "skipped", reason=f"shot {r['shot']} blocked: {blocked[r['shot']]} straight driver failures")
            elif self._room() <= 0:
                event = self._event(r["clip"], r["shot"], "skipped", reason=f"submit rate cap {self.rate}/min reached")
                if quiet:
                    break  # so would all that follow
            elif cap is not None and len(self.doc["jobs"]) >= cap:
                event = self._event(r["clip"], r["shot"], "skipped", reason=f"global attempt cap {cap} reached")
            elif self.dry_run:
                event = self._event(r["clip"], r["shot"], "dry-run", seeds=r["new"])
            else:
                event = self._submit(r["clip"], r["shot"], r["new"])
            if not quiet or event["action"] != "skipped":
                events.append(event)
        self._save()
        return sorted(events, key=lambda e: e["parent"])

    @staticmethod
    def _event(parent: str, shot: str | None, action: str, /, **more) -> dict:
        return {"event": "regen", "shot": shot, "parent": parent, "action": action} | more

    def _submit(self, clip: str, shot: str | None, seeds: dict) -> dict:
        try:
            job = external.resubmit(self.driver, clip, seeds, shot=shot)
        except external.DriverError as e:
            self.record.append((self.now(), shot, True))
            straight = [failed for _, s, failed in reversed(self.record) if s == shot]
            n = straight.index(False) if False in straight else len(straight)
            return self._event(clip, shot, "driver-error", error=str(e), failures=n, fail_block=self.fail_block)
        self.record.append((self.now(), shot, False))
        key, n = job["job"], 1
        while key in self.doc["jobs"]:
            n += 1
            key = f"{job['job']}-dup{n}"
        self.doc["jobs"][key] = {"driver": self.driver.command, "job": job["job"], "clip": job["clip"], "parent": job["parent"], "shot": shot, "seeds": seeds, "submitted": sinks.now(), "state": "queued"}
        self._save()
        return self._event(clip, shot, "submitted", job=job["job"], clip=job["clip"], seeds=seeds)

    def tick(self, fresh: DataFrame | None = None) -> Iterator[dict]:
        """Acts on fresh kills (clip), then on kills that were never sent: what
        the rate deferred, or a crash lost.  Events come as they happen."""
        takes = self._takes()
        events: list[dict] = []
        if fresh is not None and not fresh.isEmpty():
            events = self.act(fresh, takes)
            yield from events
        if not self.dry_run:
            jobs = self.jobs().select("parent")
            here = sidecars.snapshot(self.spark, self.root).select(F.col("path").alias("clip"))
            takes = self._takes() if events else takes
            late = cut(ledger.orphan_kills(takes, jobs, here).select("clip"))
            if not late.isEmpty():
                yield from self.act(late, takes, quiet=True)
