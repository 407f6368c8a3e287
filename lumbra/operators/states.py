"""Decisions about repositories, generations, worktrees, models, catalogues and evaluation corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.text import blank, slashes
from lumbra.functions.times import micros

from .tables import tasks_for

# The least and most of each retention setting; null is no bound.
POLICY = {
    "response_grace_minutes": (1, 1440), "response_retention_minutes": (1, 43_200), "response_budget_bytes": (16 << 20, None), "archive_retention_days": (1, 3650),
    "archive_entry_limit": (32, None), "generations": (1, None), "installed_versions": (2, None), "launcher_backups": (1, None), "sweep_seconds": (5, 86_400),
    "actions_per_sweep": (1, 100_000), "telemetry_retention_days": (1, 3650), "quarantine_retention_days": (1, 3650), "quarantine_entry_limit": (8, None),
    "quarantine_budget_bytes": (16 << 20, None), "quarantine_grace_hours": (1, 168),
}
TELEMETRY_DAYS = 30
DAY = 86_400_000_000
INLINE_FILES = 200


def policy_value(name: str, value: Column, grace: Column | None = None) -> Column:
    """A setting inside its bounds; the response retention is no less than the (bounded) grace."""
    least, most = POLICY[name]
    got = F.greatest(value, F.lit(least))
    got = got if most is None else F.least(got, F.lit(most))
    return got if grace is None else F.greatest(got, policy_value("response_grace_minutes", grace))


def repository_state(configured: Column, persisted: Column, published: Column, requested: Column, dirty: Column, overlay_current: Column) -> Column:
    return (
        F.when(~configured, "NotConfigured").when(persisted.isin("Initializing", "Updating", "Failed"), persisted)
        .when(blank(published), "Stale").when(published != requested, "Stale")
        .when(~dirty, "Current").when(overlay_current, "DirtyCurrent").otherwise("DirtyPending")
    )


def publishable(generations: DataFrame, overlays: DataFrame) -> DataFrame:
    """(generation, publishable): all overlays (repository, generation, ready) of its repository are ready for this generation."""
    o = overlays.select("repository", F.col("generation").alias("_for"), "ready")
    got = generations.join(o, "repository", "left").groupBy("repository", "generation")
    return got.agg(F.bool_and(F.coalesce(F.col("ready") & (F.col("_for") == F.col("generation")), F.col("ready").isNull())).alias("publishable"))


def retained_generations(generations: DataFrame, now: str, keep: int) -> DataFrame:
    """Generations (repository, id, published_at, bytes, is_current) with ``kept``.

    The current one stays, and so do those younger than a day that aren't older than it; then the newest until ``keep`` stay.
    """
    young = micros(F.lit(now)) - micros("published_at") < DAY
    own = Window.partitionBy("repository")
    got = generations.withColumn("_current", F.max(F.when(F.col("is_current"), F.col("published_at"))).over(own))
    got = got.withColumn("_held", F.coalesce(F.col("is_current") | (young & (F.col("_current").isNull() | (F.col("published_at") >= F.col("_current")))), F.lit(False)))
    # What isn't held comes last, so its place is the row's less those that are held.
    nth = F.row_number().over(own.orderBy(F.desc("_held"), F.desc("published_at"), F.desc("id")))
    got = got.withColumn("_n", F.count_if("_held").over(own)).withColumn("_nth", nth - F.col("_n"))
    return got.select("repository", "id", "bytes", (F.col("_held") | (F.col("_nth") <= F.greatest(F.lit(0), keep - F.col("_n")))).alias("kept"))


def removed_overlays(overlays: DataFrame, generations: DataFrame, reachable: DataFrame) -> DataFrame:
    """overlays (repository, generation, worktree, tree, bytes) that nothing can read: their generation isn't kept, or no worktree of ``reachable`` (worktree, tree) is at their tree."""
    kept = generations.where("kept").select("repository", F.col("id").alias("generation"))
    lost = overlays.join(kept, ["repository", "generation"], "left_anti").withColumn("reason", F.lit("generation"))
    left = overlays.join(kept, ["repository", "generation"], "left_semi").join(reachable, ["worktree", "tree"], "left_anti").withColumn("reason", F.lit("unreachable"))
    return lost.unionByName(left.select(*lost.columns))


def overlay_plan(history: DataFrame, bases: DataFrame) -> DataFrame:
    """Layers (generation, base_tree, target_tree, commit, kind, nth) over bases (generation, base_commit, base_tree).

    history (generation, age, commit, tree, parent, parent_tree), age 0 is the newest. If each commit's first parent is the one before, the oldest's is
    the base, each is a layer, oldest first; else the newest tree is one collapsed layer.
    """
    n = tasks_for(history, bases)
    own = Window.partitionBy("generation")
    order = own.orderBy(F.desc("age"))
    # One sort serves the order of ages, the join and what holds for a whole generation.
    h = history.repartition(n, "generation").withColumn("nth", F.row_number().over(order) - 1).withColumn("_before", F.lag("commit").over(order))
    h = h.join(bases.repartition(n, "generation"), "generation").withColumn("follows", F.col("parent").eqNullSafe(F.coalesce("_before", "base_commit")))
    h = h.withColumn("connected", F.bool_and("follows").over(own)).withColumn("newest", F.min("age").over(own))
    connected = F.col("connected")
    return h.where(connected | (F.col("age") == F.col("newest"))).select(
        "generation", F.when(connected, F.coalesce("parent_tree", "base_tree")).otherwise(F.col("base_tree")).alias("base_tree"), F.col("tree").alias("target_tree"), "commit",
        F.when(connected, "Commit").otherwise("Collapsed").alias("kind"), F.when(connected, F.col("nth")).otherwise(0).alias("nth"))


def read_plan(states: DataFrame, key: str, most: int = INLINE_FILES) -> DataFrame:
    """(key, to_read, reused, refused) from files (key, state): so many files would be read; a build that answers inline refuses over ``most``."""
    n = F.count_if(F.col("state") == "changed")
    return states.groupBy(key).agg(n.alias("to_read"), F.count_if(F.col("state") == "reused").alias("reused"), (n > most).alias("refused"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(rate, remaining_s): items a second so far, and the seconds that the rest takes at that rate."""
    rate = done / F.greatest(F.lit(0.001), seconds)
    return F.struct(rate.alias("rate"), ((total - done) / F.greatest(F.lit(0.001), rate)).alias("remaining_s"))


def status_counts(base: DataFrame, overlay: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row: files and chunks that are visible, base files that the overlay shadows, deleted ones, and the bytes of both indexes. base and overlay: path, chunks, bytes."""
    key = lambda d: d.select(F.lower("path").alias("_key")).distinct()
    b = base.withColumn("_key", F.lower("path")).join(key(overlay).withColumn("_o", F.lit(True)), "_key", "left").join(key(deleted).withColumn("_d", F.lit(True)), "_key", "left")
    seen = F.col("_o").isNull() & F.col("_d").isNull()
    own = b.agg(F.count_if(seen).alias("bf"), F.coalesce(F.sum(F.when(seen, F.col("chunks"))), F.lit(0)).alias("bc"), F.count_if(F.col("_o").isNotNull()).alias("shadowed"), F.count_if(F.col("_o").isNull() & F.col("_d").isNotNull()).alias("deleted"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bb"))
    more = overlay.agg(F.count("*").alias("of"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("oc"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("ob"))
    return own.crossJoin(F.broadcast(more)).select((F.col("bf") + F.col("of")).alias("files"), (F.col("bc") + F.col("oc")).alias("chunks"), "shadowed", "deleted", (F.col("bb") + F.col("ob")).alias("bytes"))  # one row each


def drift(index_tree: Column, head_tree: Column, dirty: Column, index_commit: Column, base_commit: Column, overlay_tree: Column, overlay_dirty: Column) -> Column:
    """struct(requires_overlay, overlay_matches, base_moved): the tree isn't the index's or has changes; an overlay for exactly this tree and these changes is there; the index's commit isn't the base's any more."""
    needs = ~index_tree.eqNullSafe(head_tree) | dirty.isNotNull()
    fits = overlay_tree.isNotNull() & overlay_tree.eqNullSafe(head_tree) & overlay_dirty.eqNullSafe(dirty)
    return F.struct(needs.alias("requires_overlay"), (needs & fits).alias("overlay_matches"), (~index_commit.eqNullSafe(base_commit)).alias("base_moved"))


def coverage(files: DataFrame, documents: DataFrame, projects: DataFrame, required: bool) -> DataFrame:
    """(repository, verdict): warn (``required``: fail) where a project is uncovered, or C# files exist but no C# document is indexed. files, documents: repository, path; projects: repository, covered."""
    has = lambda d, n: d.groupBy("repository").agg(F.bool_or(F.lower("path").endswith(".cs")).alias(n))
    got = has(files, "_files").join(has(documents, "_docs"), "repository", "left").join(projects.groupBy("repository").agg(F.bool_and("covered").alias("_covered")), "repository", "left")
    bad = ~F.coalesce("_covered", F.lit(True)) | (F.col("_files") & ~F.coalesce("_docs", F.lit(False)))
    return got.select("repository", F.when(bad, "fail" if required else "warn").otherwise("ok").alias("verdict"))


def saturated_sum(tokens: Column, most: int = 2_147_483_647) -> Column:
    return F.least(F.coalesce(F.sum(tokens), F.lit(0)), F.lit(most))


def job_tokens(characters: Column, verification: Column, validator: Column, passed: Column) -> Column:
    """struct(gross, verification, net, validator) of one job."""
    gross = F.floor((characters + 3) / 4)
    return F.struct(gross.alias("gross"), verification.alias("verification"), F.greatest(F.lit(0), gross - verification).alias("net"), F.concat(validator, F.when(passed, ":pass").otherwise(":fail")).alias("validator"))


def present(worktrees: DataFrame, existing: DataFrame) -> DataFrame:
    """worktrees (path, ..) with ``present``: their folder exists."""
    return worktrees.join(existing.select("path", F.lit(True).alias("present")).distinct(), "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def model_fit(adapters: DataFrame, choices: DataFrame) -> DataFrame:
    """(machine, minimal, recommended, extended) from adapters (machine, adapter, bytes, chosen) and choices (model, context, bytes, enabled).

    A chosen adapter wins, else that with most bytes. Of the enabled choices that it holds, by bytes, model and context: the first, the lower median and the last.
    """
    best = adapters.groupBy("machine").agg(F.max(F.struct(F.col("chosen").cast("int"), "bytes", "adapter")).alias("a")).select("machine", F.col("a.bytes").alias("room"))
    # How many choices a room holds follows from their place in one order; choices meet machines by that number, not by size.
    order = Window.orderBy("bytes", "model", "context")
    placed = choices.where("enabled").select("bytes", "model", "context").withColumn("nth", F.row_number().over(order) - 1)  # the catalogue of models, not data
    upto = placed.groupBy("bytes").agg((F.max("nth") + 1).alias("n"))
    marks = upto.select("bytes", "n", F.lit(0).alias("kind"), F.lit(None).cast(best.schema["machine"].dataType).alias("machine")).unionByName(best.select(F.col("room").alias("bytes"), F.lit(None).cast("int").alias("n"), F.lit(1).alias("kind"), "machine"))
    held = marks.withColumn("n", F.max("n").over(Window.orderBy("bytes", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1").select("machine", "n")
    picks = {"minimal": F.lit(0), "recommended": F.floor((F.col("n") - 1) / 2).cast("int"), "extended": F.col("n") - 1}
    asked = held.where("n > 0").select("machine", F.explode(F.array(*[F.struct(F.lit(name).alias("pick"), at.cast("int").alias("nth")) for name, at in picks.items()])).alias("p")).select("machine", "p.*")
    got = asked.join(placed.select("nth", "model"), "nth").groupBy("machine").agg(*[F.max(F.when(F.col("pick") == name, F.col("model"))).alias(name) for name in picks])
    return best.select("machine").join(got, "machine", "left")


def expired(files: DataFrame, now: str, days: int = TELEMETRY_DAYS) -> DataFrame:
    """Telemetry files (name, ..) older than ``days`` by the ticks (100 ns since year 1) that their names begin with; names without them stay."""
    ticks = F.regexp_extract("name", r"^(\d{18,19})", 1)
    us = F.when(ticks != "", (ticks.cast("long") - 621_355_968_000_000_000) / 10)
    return files.where(us < micros(F.lit(now)) - days * DAY)


def corpus_problems(cases: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, problem): the first check that an evaluation case fails, in the checks' order.

    cases (case_id, query, category, no_answer), targets (case_id, path, symbol), sources (path, text). A target's file must exist and hold the last part of its symbol.
    """
    texts = sources.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
    name = F.element_at(F.split("symbol", r"\."), -1)
    own = targets.withColumn("_place", slashes(F.col("path"))).join(texts, F.col("_place") == F.col("_path"), "left")
    own = own.groupBy("case_id").agg(
        F.count("*").alias("_n"), F.bool_or(blank(F.col("path"))).alias("_blank"), F.bool_or(F.col("_path").isNull()).alias("_missing"),
        F.bool_or(~blank(F.col("symbol")) & ~F.contains("_text", name)).alias("_absent"),
    )
    times = cases.groupBy("case_id").agg(F.count("*").alias("_times"))
    got = cases.join(times, "case_id").join(own, "case_id", "left")
    problem = (
        F.when(blank(F.col("case_id").cast("string")) | blank(F.col("query")) | blank(F.col("category")), "blank").when(F.col("_times") > 1, "duplicate")
        .when(F.col("no_answer") == (F.coalesce("_n", F.lit(0)) > 0), "inconsistent").when(F.col("_blank"), "blank_path").when(F.col("_missing"), "missing").when(F.col("_absent"), "symbol_absent")
    )
    return got.select("case_id", problem.alias("problem")).where("problem is not null").distinct()


def catalogue_problems(models: DataFrame, routes: DataFrame, named: DataFrame, allowed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(subject, problem) of a routing catalogue.

    models (tag, lifecycle, policy), routes (profile, mode), named (profile, tag, role: candidate or fallback), allowed (tag), profiles (profile). Tags and the allow-list
    are unique, each profile has one route, model routes have candidates and fallbacks, deterministic ones none, all tags are known, and allowed
    models are recommended or experimental.
    """
    twice = lambda d, c, p: d.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.col(c).alias("subject"), F.lit(p).alias("problem"))
    roles = named.groupBy("profile").agg(F.count_if(F.col("role") == "candidate").alias("c"), F.count_if(F.col("role") == "fallback").alias("f"))
    r = routes.join(roles, "profile", "left").na.fill(0, ["c", "f"])
    unknown = named.join(models.select("tag"), "tag", "left_anti").select(F.col("profile").alias("subject"), F.lit("unknown_model").alias("problem"))
    wrong = allowed.join(models.where("lifecycle = 'experimental' or policy = 'recommended'").select("tag"), "tag", "left_anti").select(F.col("tag").alias("subject"), F.lit("not_allowed").alias("problem"))
    parts = [
        twice(models, "tag", "duplicate_tag"), twice(routes, "profile", "duplicate_route"), twice(allowed, "tag", "duplicate_allowed"),
        profiles.join(routes, "profile", "left_anti").select(F.col("profile").alias("subject"), F.lit("no_route").alias("problem")),
        r.where("mode = 'model' and (c = 0 or f = 0)").select(F.col("profile").alias("subject"), F.lit("incomplete").alias("problem")),
        r.where("mode = 'deterministic' and c + f > 0").select(F.col("profile").alias("subject"), F.lit("names_models").alias("problem")), unknown, wrong,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
