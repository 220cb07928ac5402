"""One entry point over a store of catalog tables: ingest, reports, search, visibility."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import classify
from strata.operators import catalog, filters, lineage, narrative, reports, scan, search, sinks, visibility
from strata.sources.store import Store, staged
from strata.streaming import incremental

RULE = "id int, priority int, field string, mode string, pattern string, visibility string, source_scope string, threshold double, enabled boolean"

#: Version of what the catalog derives from session tables. Another one derives the catalog anew and reads no transcript; the version of
#: the tables themselves is `incremental.PARSED`, that of the index `search.VERSION`.
STORY = 1
USER = "username string, display_name string, profile_visibility string, default_visibility string"


def _before(today: str, days: int) -> str:
    return (datetime.date.fromisoformat(today) - datetime.timedelta(days=days)).isoformat()


class Engine:
    """Lazy queries over the newest versions of the tables in `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # Ingest.

    def sync(self, folders: list[tuple[str, str, int]], ignore: tuple[str, ...] = (), markers: tuple[str, ...] = ()) -> int:
        """Read new and changed transcripts, then derive what depends on whole sessions."""
        self.store.vacuum()
        count = incremental.sync(self.spark, folders, self.store, ignore, markers)
        self.catch_up()
        return count

    def stream(self, folder: str, dialect: str, checkpoint: str, **options):
        """As `sync`, for the new files of a folder by Structured Streaming; the catalog and a built index follow every batch."""
        return incremental.stream(self.spark, folder, dialect, self.store, checkpoint, after=lambda count: self.catch_up(), **options)

    def adopt(self, copies: DataFrame) -> None:
        """Take managed copies (file, copy, sha256) on record, to be read where a source is gone."""
        copies = staged(copies.select("file", "copy", "sha256"), "copies")
        self.store.replace("copies", copies, copies.select("file").distinct(), "file")

    def catch_up(self) -> None:
        """Derive the catalog if it is behind the sessions, and refresh an index that was built. A run that broke off between is
        so made good by the next."""
        now = f"{self.store.version('sessions')}/{STORY}"
        if self.store.version("sessions") and self.store.marks().get("derived") != now:
            with self.store.batch():
                self.derive()
                self.store.mark("derived", now)
        if self.store.version("search_states"):
            self.index()

    def derive(self, workspaces: DataFrame | None = None) -> None:
        """Activity, narrative, origin, objective and parents of all sessions, as the table `catalog`."""
        base = self.store.read("sessions")
        sessions = narrative.with_repositories(base, workspaces) if workspaces is not None else base.withColumns({"repo_name": F.lit(None).cast("string"), "branch": F.lit(None).cast("string"), "worktree_root": F.lit(None).cast("string")})
        paths = self.store.read("session_paths")
        ordered = paths.withColumn("seq", F.col("first_timestamp"))
        rows = sessions.join(narrative.activity(sessions, self.store.read("tool_calls"), paths), "session_id").join(narrative.sampled_paths(ordered), "session_id", "left")
        told = narrative.narrative(rows).drop("samples")
        seed = classify.objective_seed(F.col("session_goal"), F.col("first_user_message"), F.col("session_summary"))
        told = told.withColumns({
            "session_origin": classify.session_origin(F.col("first_user_message"), F.col("session_id"), F.col("project"), F.col("workspace_root"), F.col("file")),
            "objective_family": classify.objective_family(seed), "objective_label": classify.objective_label(seed),
            "subagent": classify.is_subagent(F.col("spawn_depth"), F.col("source"), F.col("parent_thread_id"), F.col("file")),
            "duration_seconds": F.when(F.col("source") == "claudecode", classify.duration_seconds(F.col("first_timestamp"), F.col("last_timestamp"))),
            "username": F.lit("local"), "visibility": F.lit("unlisted"), "visibility_source": F.lit("default"),
            **{c: F.lit(None).cast("string") for c in ("default_visibility", "reviewed_hash", "reviewed_metadata_hash")}})
        told = told.withColumn("metadata_hash", search.metadata_hash(told)).join(self.store.read("file_hashes", "file string, file_hash string"), "file", "left")
        told = told.join(lineage.resolve_parents(told), "session_id", "left")
        if rules := self.rules():
            ruled = visibility.recompute(told, rules)
            told = ruled.withColumns({"visibility": F.col("next_visibility"), "visibility_source": F.when(F.startswith("reason", F.lit("rule ")), "rule").otherwise(F.col("visibility_source"))}).drop("next_visibility", "reason")
        # What people decided outlives an ingest: users, manual levels and reviews; changed public sessions fall back.
        if self.store.version("catalog"):
            held = self.store.read("catalog")
            names = held.select("session_id", F.col("username").alias("_user"), F.col("default_visibility").alias("_default"))
            told = told.join(names, "session_id", "left").withColumns({"username": F.coalesce("_user", "username"), "default_visibility": F.coalesce("_default", "default_visibility")}).drop("_user", "_default")
            told = sinks.upsert_sessions(held, told)
        private = self.store.read("private_files", "file string").select("file", F.lit("private").alias("marked"))
        told = told.join(private, "file", "left").withColumn("visibility", F.coalesce("marked", "visibility")).drop("marked")
        self.store.write("catalog", told)

    # Tables.

    def sessions(self, origin: str = "all") -> DataFrame:
        return self.store.read("catalog").filter(filters.origin(origin))

    def open_sessions(self) -> DataFrame:
        """Sessions without a privacy marker."""
        return self.sessions().filter("visibility <> 'private'")

    def daily(self) -> DataFrame:
        return catalog.daily_effective(self.store.read("session_daily_usage"), self.sessions())

    # Queries.

    def stats(self, today: str, username: str | None = None, since: str | None = None, until: str | None = None) -> dict[str, DataFrame]:
        return reports.stats(self.sessions(), self.daily(), self.store.read("tool_calls"), today, username, since, until)

    def stats_text(self, today: str, **bounds: str | None) -> list[str]:
        """The five reports as printed lines."""
        return reports.stats_text(self.stats(today, **bounds))

    def top_tools(self, limit: int = 20) -> DataFrame:
        return reports.top_tools(self.store.read("tool_calls"), self.sessions(), limit)

    def index(self, batch: int = 20_000) -> int:
        """Index the sessions that are new or changed; tells how many."""
        return search.refresh_index(self.store, self.open_sessions(), self.store.read("turns"), batch)

    def search(self, query: str, limit: int = 20, public: bool = False) -> DataFrame:
        """The best document of each session whose index is current; in public mode of reviewed public sessions alone."""
        held = self.store.read("search_postings"), search.summed_sizes(self.store.read("search_sizes"))
        sessions = search.stamped(self.open_sessions())
        if public:
            flags = catalog.session_catalog(sessions.drop("default_visibility"), self.users())
            sessions = flags.withColumns({"reviewed_hash": F.concat_ws("/", "reviewed_hash", "reviewed_metadata_hash")})
        allowed = search.eligible(self.store.read("search_states", search.STATE), sessions, public)
        return search.search(self.store.read("search_index"), sessions, query, allowed, limit, public, held)

    def show(self, session_id: str) -> DataFrame:
        """Turns of one session in order; a unique prefix of its id will do."""
        one = filters.by_prefix(self.sessions(), session_id)
        return self.store.read("turns").join(one.select("session_id"), "session_id", "left_semi").orderBy("seq")

    def context(self, today: str, days: int = 7, public: bool = False, **limits) -> DataFrame:
        """Workstreams of the last days that used very many tokens."""
        listed = self.listed(public).drop("user_display_name")
        return lineage.workstreams(listed, _before(today, days), **limits)

    def relaunches(self, today: str, days: int = 30, **limits) -> DataFrame:
        return reports.relaunches(self.open_sessions(), since=_before(today, days), **limits)

    def users(self) -> DataFrame:
        return self.store.read("users", USER)

    def listed(self, public: bool = False) -> DataFrame:
        """Sessions that a read mode may list, with their users' settings."""
        return catalog.session_catalog(self.sessions().drop("profile_visibility", "default_visibility"), self.users()).filter("listed_public" if public else "listed_private")

    def profiles(self, public: bool = True) -> DataFrame:
        """Users whose profile may be opened."""
        return catalog.directly_visible(self.users(), self.sessions().drop("default_visibility"), public)

    def forensic(self, lines: DataFrame, words: str, limit: int = 20, public: bool = False) -> DataFrame:
        return search.forensic(self.listed(public), self.store.read("tool_calls"), lines, words, limit, public)

    # Publication.

    def review(self) -> tuple[DataFrame, DataFrame]:
        """(findings, recommendations) of transcripts and metadata."""
        turns = self.store.read("turns").select("session_id", F.lit("transcript").alias("source"), "text")
        meta = scan.metadata_rows(self.open_sessions(), [f for f in scan.METADATA if f in self.open_sessions().columns])
        found = scan.findings(turns.unionByName(meta))
        return found, scan.recommendation(self.open_sessions(), found)

    def rules(self) -> list[dict]:
        """Visibility rules in order; they are configuration, a few dozen at most."""
        rows = self.store.read("rules", RULE).orderBy("priority", "id").collect()
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]

    def add_rule(self, field: str, mode: str, pattern: str, level: str, priority: int = 100, source_scope: str = "all", threshold: float | None = None, enabled: bool = True) -> int:
        visibility.match_score(mode, pattern, F.lit(""))  # an unknown mode is an error here
        held = self.rules()
        number = max((r["id"] for r in held), default=0) + 1
        held.append({"id": number, "priority": priority, "field": field, "mode": mode, "pattern": pattern, "visibility": level, "source_scope": source_scope, "threshold": threshold, "enabled": enabled})
        self._write_rules(held)
        return number

    def delete_rule(self, number: int) -> bool:
        held = self.rules()
        left = [r for r in held if r["id"] != number]
        if len(left) < len(held):
            self._write_rules(left)
        return len(left) < len(held)

    def _write_rules(self, rules: list[dict]) -> None:
        names = [x.split()[0] for x in RULE.split(", ")]
        self.store.write("rules", self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rules], RULE))

    def recompute_visibility(self, rules: list[dict] | None = None) -> DataFrame:
        """Sessions with `next_visibility`, what the rules (the stored ones by default) make of them; nothing is written."""
        return visibility.recompute(self.open_sessions(), self.rules() if rules is None else rules)

    def apply_rules(self) -> None:
        """Give all sessions but the manual and private ones the level of the stored rules."""
        new = self.recompute_visibility().select("session_id", F.col("next_visibility").alias("_next"))
        rows = self.sessions().join(new, "session_id", "left")
        moved = F.col("_next").isNotNull() & (F.col("_next") != F.col("visibility"))
        self.store.write("catalog", rows.withColumns({"visibility_source": F.when(moved, "rule").otherwise(F.col("visibility_source")), "visibility": F.coalesce("_next", "visibility")}).drop("_next"))

    def set_visibility(self, wanted: DataFrame, actor: str, at: str) -> DataFrame:
        """Apply levels (session_id, target) by hand; returns and keeps the audit rows."""
        after, audit = visibility.transition(self.sessions(), wanted, actor, at)
        after, audit = staged(after, "catalog"), staged(audit, "audit")
        self.store.write("catalog", after)
        self.store.write("audit", self.store.read("audit", audit.schema).unionByName(audit))
        return audit

    def mark_reviewed(self, session_ids: DataFrame) -> None:
        """Take the present file and metadata of sessions as reviewed."""
        rows = self.sessions().join(session_ids.select("session_id", F.lit(True).alias("_seen")).distinct(), "session_id", "left")
        self.store.write("catalog", rows.withColumns({f"reviewed_{h}" if h != "file_hash" else "reviewed_hash": F.when(F.col("_seen"), F.col(h)).otherwise(F.col(f"reviewed_{h}" if h != "file_hash" else "reviewed_hash")) for h in ("file_hash", "metadata_hash")}).drop("_seen"))

    def backup_plan(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        plan = sinks.backup_plan(files)
        return plan, sinks.plan_totals(plan)
