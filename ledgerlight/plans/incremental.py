"""An analysis that is brought up to date where something changed, instead of being run anew.

What an analysis leaves is a version in a folder: its findings and cases, and what its rules measure works by (costs and profiles of peer
groups, overruns, counts of words, pairs of like descriptions). After a change each rule looks again only where its own scope was touched:

    one work         R-TIME-01 R-PROH-01 R-COST-01 R-SANC-01, payments (P-*), edits (V-AMT-01 V-IA-01 V-VEN-01 V-PAY-01)
    peer group       A-COST-01 A-PEER-01: the statistics of a changed work's group are measured again, and works are judged again in
                     groups whose statistics moved
    actor            N-NET-01: of changed works, of works that became or ceased to be overruns, and of namesakes
    authority        district summaries, R-SANC-02
    member           R-REPAIR-01 R-TRUST-01
    block            D-DUP-01 D-DUP-02: state and district of changed works, and of works with a word that became or ceased to be common

Both the old and the new place of a changed work count. Rules that rest on sums over everything (R-SCST-02, fund positions, V-REV-01,
V-FREQ-01, V-LIST-01) are few rows or one aggregate and run whole. Findings and cases of all else stay as they are. Where another day is
asked for, rules that count days run whole; where a column gains its first value or loses its last, rules start or stand down and
everything runs anew.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import scalar as S
from ledgerlight.operators import compliance, duplicates, network, payments, peers, revisions
from ledgerlight.operators.findings import together
from ledgerlight.plans import analysis, cases
from ledgerlight.tables import drop, folders, get_text, put_text, written

OF_WORK = ("R-TIME-01", "R-PROH-01", "R-COST-01", "R-SANC-01", "P-SEQ-01", "P-LATE-01", "P-DUP-01", "V-AMT-01", "V-IA-01", "V-VEN-01", "V-PAY-01")
OF_AUTHORITY = ("R-COST-01", "R-SANC-01", "R-SANC-02")
OF_MEMBER = ("R-REPAIR-01", "R-TRUST-01")
WHOLE = ("R-SCST-02", "A-EXP-01", "R-SCST-01", "R-SPIKE-01", "R-PILE-01", "V-REV-01", "V-FREQ-01", "V-LIST-01", "D-DUP-01")
#: Rules that count days up to today.
DATED = ("R-TIME-01", "R-SANC-01", "R-SPIKE-01")
TABLES = ("findings", "cases", "cost", "profile", "overruns", "words", "pairs")


@dataclass
class Kept:
    """A version of an analysis. Frames read its tables."""

    number: int
    today: str
    have: dict[str, bool]
    notes: dict[str, str]
    frames: dict[str, DataFrame]
    #: Works that each rule looked at again; empty where all ran anew.
    looked_at: dict[str, int] = field(default_factory=dict)

    @property
    def findings(self) -> DataFrame:
        return self.frames["findings"]

    @property
    def cases(self) -> DataFrame:
        return self.frames["cases"]


class History:
    """The versions of an analysis in a folder. A version is there once its note is; a run that is lost before leaves the one before in place."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _note(self, number: int) -> str:
        return f"{self.root}/{number:06}/note.json"

    def newest(self) -> Kept | None:
        numbers = [int(x) for x in folders(self.spark, self.root) if get_text(self.spark, self._note(int(x))) is not None]
        return self.read(max(numbers)) if numbers else None

    def read(self, number: int) -> Kept:
        note = json.loads(get_text(self.spark, self._note(number)) or "null")
        if note is None:
            raise FileNotFoundError(f"{self.root} has no analysis {number}")
        frames = {t: self.spark.read.parquet(f"{self.root}/{number:06}/{t}") for t in note["tables"]}
        return Kept(number, note["today"], note["have"], note["notes"], frames, note["looked_at"])

    def write(self, kept: Kept) -> Kept:
        for t, df in kept.frames.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{kept.number:06}/{t}")
        put_text(self.spark, self._note(kept.number), json.dumps({"today": kept.today, "have": kept.have, "notes": kept.notes, "tables": list(kept.frames), "looked_at": kept.looked_at}))
        return self.read(kept.number)


def run_whole(history: History, corpus: analysis.Corpus, today: str, number: int | None = None) -> Kept:
    """The analysis over everything, written as the next version."""
    if number is None:
        last = history.newest()
        number = 0 if last is None else last.number + 1
    try:
        parts = analysis.parts_of(corpus)
        found, notes = analysis.findings(corpus, today, parts)
        found = written(found)
        frames = {"findings": found, "cases": folded(found, corpus), "cost": parts.cost, "profile": parts.profile, "overruns": parts.overruns, "words": parts.words}
        if parts.pairs is not None:
            frames["pairs"] = parts.pairs
        out = history.write(Kept(number, today, parts.have, notes, frames))
        drop(found)
        return out
    finally:
        corpus.release()


def folded(found: DataFrame, corpus: analysis.Corpus) -> DataFrame:
    return cases.with_entities(cases.cases(found), corpus.records(), corpus.retired)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def within(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose values of the columns of keys are among keys; nulls alike. keys is a written table."""
    names = {c: f"_k_{c}" for c in keys.columns}
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(keys.withColumnsRenamed(names), on, "left_semi")


def beyond(df: DataFrame, keys: DataFrame) -> DataFrame:
    names = {c: f"_k_{c}" for c in keys.columns}
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(keys.withColumnsRenamed(names), on, "left_anti")


def moved(old: DataFrame, new: DataFrame, keys, groups: DataFrame) -> DataFrame:
    """Groups, of the given ones, in which the two frames don't have the same rows. keys: the columns of groups."""
    rows = lambda df: within(df, groups).select(*keys, F.xxhash64(*sorted(df.columns)).alias("_h"))
    count = lambda df, n: df.select(*keys, "_h", F.lit(n).alias("_n"))
    return union(count(rows(old), 1), count(rows(new), -1)).groupBy(*keys, "_h").agg(F.sum("_n").alias("_n")).where("_n <> 0").select(*keys).distinct()


class Update:
    """One update of an analysis: ``removed`` and ``added`` findings of each rule, and its measures as they are now."""

    def __init__(self, before: Kept, old: DataFrame, corpus: analysis.Corpus, changed: DataFrame, today: str) -> None:
        self.before, self.corpus, self.today = before, corpus, today
        self.spark, self.works = corpus.works.sparkSession, corpus.records().withColumn("work_id", F.col("work_id").cast("string"))
        self.ids = written(changed.select(F.col("work_id").cast("string").alias("work_id")).distinct())
        self.was, self.now = (written(within(w.withColumn("work_id", F.col("work_id").cast("string")), self.ids)) for w in (old, self.works))
        self.removed: list[DataFrame] = []
        self.added: list[DataFrame] = []
        self.looked_at: dict[str, int] = {}
        self.frames: dict[str, DataFrame] = {}

    def places(self, *columns) -> DataFrame:
        """Distinct values of some columns at the changed works, as they were and as they are."""
        return written(union(self.was.select(*columns), self.now.select(*columns)).distinct())

    def replace(self, rules, entities: DataFrame, frames: list[DataFrame], kind: str = "work") -> None:
        """Findings of some rules on some entities (entity_id) give way to new ones."""
        old = self.before.findings.where(F.col("rule_id").isin(*rules) & (F.col("entity_type") == kind))
        self.removed.append(within(old, entities.select(F.col(entities.columns[0]).cast("string").alias("entity_id"))))
        if frames:
            self.added.append(together(*frames).where(F.col("rule_id").isin(*rules) & (F.col("entity_type") == kind)))

    def replace_all(self, rules, frames: list[DataFrame]) -> None:
        self.removed.append(self.before.findings.where(F.col("rule_id").isin(*rules)))
        if frames:
            self.added.append(together(*frames))

    # ------------------------------------------------------------ rules by scope
    def single_works(self) -> None:
        have, today, c = self.before.have, self.today, self.corpus
        dated = [] if today == self.before.today else list(DATED)
        rules = [r for r in OF_WORK if r not in dated]
        frames = []
        for w, names in ((self.now, rules), (self.works, dated)):
            if not names:
                continue
            own = [compliance.completion_norm(w, today), compliance.cost_limits(w)]
            own += [compliance.sanction_waits(w, today)] if have["recommended_date"] else []
            own += [compliance.prohibited(w)] if have["description"] else []
            if c.payments is not None:
                p = within(c.payments.withColumn("work_id", F.col("work_id").cast("string")), self.ids) if names is rules else c.payments
                own += payments.found(written(payments.measured(p, w)))
            if c.versions is not None:
                v = revisions.with_occasion(within(c.versions.withColumn("work_id", F.col("work_id").cast("string")), self.ids) if names is rules else c.versions, w)
                own += [revisions.amount_changes(v), revisions.agency_changes(v), revisions.vendor_changes(v), revisions.payment_reversals(v)]
            frames.append((names, own))
        for names, own in frames:
            if names is rules:
                self.replace(names, self.ids, own)
            else:
                self.removed.append(self.before.findings.where(F.col("rule_id").isin(*names) & (F.col("entity_type") == "work")))
                self.added.append(together(*own).where(F.col("rule_id").isin(*names) & (F.col("entity_type") == "work")))
        self.looked_at["work"] = self.ids.count()

    def peer_groups(self) -> None:
        group = list(peers.GROUP)
        groups = written(union(peers.with_group(self.was).select(*group), peers.with_group(self.now).select(*group)).distinct())
        mine = peers.with_group(self.works)
        measured = {"cost": peers.cost_stats, "profile": peers.profile_stats}
        again: dict[str, DataFrame] = {}
        for name, of in measured.items():
            new = written(of(within(mine, groups)))
            old = self.before.frames[name]
            self.frames[name] = written(union(beyond(old, groups), new))
            again[name] = written(within(mine, written(moved(old, new, group, groups))).select("work_id").union(self.ids).distinct())
            self.looked_at[name] = again[name].count()
        # costs, and the overruns that N-NET-01 counts
        rated = written(peers.far_above(within(self.works, again["cost"]), analysis.FAR, self.frames["cost"]))
        self.replace(["A-COST-01"], again["cost"], [peers.cost_outliers(self.works, rated=rated)])
        kept, new = self.before.frames["overruns"].withColumn("work_id", F.col("work_id").cast("string")), network.overruns(rated)
        stay = beyond(kept, again["cost"])
        self.frames["overruns"] = written(union(stay, new))
        self.turned = written(union(beyond(within(kept, again["cost"]), written(new)), beyond(new, written(kept))).distinct())
        if self.before.have["total_paid"]:
            self.replace(["A-PEER-01"], again["profile"], [peers.profile_outliers(within(self.works, again["profile"]), stats=self.frames["profile"])])

    def actors(self) -> None:
        """After peer_groups, which finds the works whose marks turned."""
        if not (self.before.have["vendor_id"] or self.before.have["ia_name"]):
            return
        hit = written(union(self.was, self.now, within(self.works, self.turned)))
        for kind in network.kinds(self.works):
            ids = self.before.have["vendor_id"]  # whether vendors go by id or by name follows from all works
            of = lambda df, kind=kind, ids=ids: network.actors(df, kind, ids)
            own = of(hit)
            names = written(own.select("name").where("name <> ''").distinct())
            namesakes = within(of(self.works), names).select("actor_key")
            only = written(union(own.select("actor_key"), namesakes).distinct())
            entities = only.select(network.actor_id(kind).alias("entity_id"))
            self.replace(["N-NET-01"], entities, [network.actor_signals(self.works, kind, marks=self.frames["overruns"], only=only, ids=ids)], "agency")
            self.looked_at[kind] = only.count()

    def authorities(self) -> None:
        w, today = self.works, self.today
        places = self.places("ia_name") if today == self.before.today else written(w.select("ia_name").distinct())
        own = within(w, places)
        frames = [compliance.below_minimum_by_district(own)]
        if self.before.have["recommended_date"]:
            frames += [compliance.sanction_waits_by_district(own, today), compliance.sanction_patterns(own)]
        self.replace(OF_AUTHORITY, places, frames, "agency")

    def members(self) -> None:
        if not self.before.have["work_category"]:
            return
        places = self.places(S.entity_key().alias("member"))
        own = within(self.works.withColumn("member", S.entity_key()), places).drop("member")
        self.replace(OF_MEMBER, places, [compliance.repair_cap(own), compliance.trust_cap(own)], "constituency")

    def blocks(self) -> None:
        """Like descriptions: pairs are looked for again in the blocks that changed; D-DUP-01 judges all pairs, which are few."""
        if not self.before.have["description"]:
            return
        old, counts = self.before.frames["words"], duplicates.word_counts
        signed = lambda df, sign: df.select("t", (F.col("df") * sign).alias("df"))
        delta = union(signed(old, 1), signed(counts(duplicates.described(self.was)), -1), signed(counts(duplicates.described(self.now)), 1))
        self.frames["words"] = written(delta.groupBy("t").agg(F.sum("df").alias("df")).where("df > 0"))
        common, common_before = (written(duplicates.common_words(c)) for c in (self.frames["words"], old))
        turned = written(union(beyond(common, common_before), beyond(common_before, common)))
        block = list(duplicates.BLOCK)
        named = lambda df: df.withColumns({c: F.coalesce(F.col(c), F.lit("NA")) for c in block})
        hit = union(named(self.was).select(*block), named(self.now).select(*block))
        if not turned.isEmpty():
            holding = within(named(self.works).select(*block, F.explode(S.tokens("description")).alias("t")), turned)
            hit = union(hit, holding.select(*block))
        places = written(hit.distinct())
        own = written(within(named(self.works), places))
        # works that were there and have moved away count too
        gone = written(union(own.select("work_id"), self.ids).distinct())
        self.replace(["D-DUP-02"], gone, [duplicates.generic_clusters(within(self.works, gone), common=common)])
        again = duplicates.candidate_pairs(own, common=common)
        stay = beyond(self.before.frames["pairs"], gone.select(F.col("work_id").alias("a")))
        self.frames["pairs"] = written(union(stay, again.select(*stay.columns)))
        self.replace_all(["D-DUP-01"], duplicates.near_duplicates(self.works, self.corpus.payments, self.corpus.photos, keep=self.corpus.keep, candidates=self.frames["pairs"]))
        self.looked_at["block"] = own.count()

    def sums(self) -> None:
        c, frames = self.corpus, []
        if self.before.have["is_sc_constituency"]:
            frames.append(compliance.reserved_shares(self.works))
        if c.flows is not None:
            f = c.keep(c.flows)
            frames += [peers.expenditure_outliers(f), compliance.area_shares(f), compliance.utilization_spikes(f, self.today), compliance.pileups(f)]
        if c.versions is not None:
            v = c.keep(revisions.with_occasion(c.versions, self.works))
            frames += [revisions.place_changes(v), revisions.frequent_revisions(v)]
        if c.retired is not None:
            frames.append(revisions.removed_after_payment(c.retired))
        self.replace_all([r for r in WHOLE if r != "D-DUP-01"], frames)

    # ------------------------------------------------------------ all together
    def run(self) -> Kept:
        for step in (self.single_works, self.peer_groups, self.actors, self.authorities, self.members, self.blocks, self.sums):
            step()
        removed, added = written(union(*self.removed)), written(union(*self.added))
        row = lambda df, n: df.select("entity_type", "entity_id", F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("_h"), F.lit(n).alias("n"))
        # findings that come back as they were touch no case
        differ = union(row(removed, 1), row(added, -1))
        differ = differ.groupBy("entity_type", "entity_id", "_h").agg(F.sum("n").alias("n")).where("n <> 0").select("entity_type", "entity_id")
        touched = written(union(differ, self.ids.select(F.lit("work").alias("entity_type"), F.col("work_id").alias("entity_id"))).distinct())
        found = written(union(beyond(self.before.findings, removed.select("rule_id", "entity_type", "entity_id").distinct()), added))
        mine = within(found, touched)
        new = folded(mine, self.corpus)
        case = union(beyond(self.before.cases, touched).select(*new.columns), new)
        self.looked_at["case"] = touched.count()
        frames = {**self.before.frames, **self.frames, "findings": found, "cases": case}
        return Kept(self.before.number + 1, self.today, self.before.have, self.before.notes, {t: frames[t] for t in TABLES if t in frames}, self.looked_at)


def run_update(history: History, old: DataFrame, corpus: analysis.Corpus, changed: DataFrame, today: str) -> Kept:
    """The next version, brought up to date from the newest one. old: the works as that one saw them; corpus: everything as it is now; changed:
    work_id of works that are new, gone or different, or whose payments or edits are."""
    before = history.newest()
    try:
        if before is None or cases.usable(corpus.records(), *analysis.NEEDED) != before.have or set(analysis.stood_down(corpus, before.have)) != set(before.notes):
            return run_whole(history, corpus, today)
        return history.write(Update(before, old, corpus, changed, today).run())
    finally:
        corpus.release()
