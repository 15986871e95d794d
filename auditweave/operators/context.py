"""Security context per project: framework, authentication, routes, models and roles."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.catalogues import DEFAULT_CATALOGUE, DEFAULT_LANGUAGE, Catalogue
from auditweave.functions import patterns as rx
from auditweave.functions import text
from auditweave.operators.manifest import changed_projects, file_manifest
from auditweave.plans.joins import MAX_BROADCAST_ROWS, lookup_join
from auditweave.plans.joins import stored as stored_once
from auditweave.sources.files import admitted, files_of, is_admitted
from auditweave.sources.roots import manifest_languages

ROLE_MARGIN = 50
#: A character that hardly any text holds.
MARK = "\x01"

# The layout of the rendered context.
NO_AUTH = "No authentication patterns detected."
AUTH_TITLE = "Auth mechanisms detected:"
CONTEXT_TITLE = "=== CODEBASE SECURITY CONTEXT ==="
TRUNCATED = "\n... (truncated)"
SHOWN = {"routes": 30, "models": 20, "roles": 15, "middleware": 10}
OVERVIEW_SHOWN = {"routes": 20, "models": 15}
OVERVIEW_AUTH_CHARS = 200

#: What the texts are searched for. Routes and models follow from the language, hence from the framework.
KINDS = ("framework", "auth", "routes", "models", "roles")


def sample_files(
    files: DataFrame, limit: int | None = vocab.SAMPLE_FILES, max_bytes: int | None = vocab.MAX_FILE_BYTES
) -> DataFrame:
    """The first ``limit`` admitted files of every project in path order; ``path`` is unique in it.

    Without a ``limit`` these are all admitted files. Otherwise paths are ranked without their contents. The rank
    filter cuts every input partition to ``limit`` paths per project before the shuffle, and one last path per project that
    fills its sample then selects the contents. So a huge project neither fills a task nor shuffles its texts, and as
    long as few projects are that large no texts are shuffled at all.
    """
    chosen = admitted(files, max_bytes)
    if limit is None:
        return chosen.select("project", "path", "content")
    if limit < 1:
        raise ValueError("a sample has at least one file")
    chosen = chosen.filter(F.col("project").isNotNull())
    count = F.count(F.lit(1)).alias("_files")
    full = chosen.groupBy("project").agg(count).filter(F.col("_files") >= limit).limit(MAX_BROADCAST_ROWS + 1).count()
    by_path = Window.partitionBy("project").orderBy("path")
    ranked = chosen.select("project", "path", F.row_number().over(by_path).alias("_rank")).filter(F.col("_rank") <= limit)
    last = ranked.groupBy("project").agg(F.max("path").alias("_last"), count).filter(F.col("_files") == limit).drop("_files")
    rows = lookup_join(chosen, last, "project", "left", spread=["path"], size_of=full)
    return rows.filter(F.col("_last").isNull() | (F.col("path") <= F.col("_last"))).select("project", "path", "content")


def _first_framework(catalogue: Catalogue) -> Column:
    """The first framework in catalogue order with any hit in the file, or null."""
    found = F.lit(None).cast("string")
    for name, patterns in reversed(catalogue.frameworks.items()):
        found = F.when(rx.found(F.col("content"), patterns), F.lit(name)).otherwise(found)
    return found


def _hits(patterns: Sequence[str], trim: bool) -> Column:
    """Distinct matches of one file, pattern by pattern, in the order of first appearance."""
    found = [rx.all_matches(F.col("content"), p) for p in patterns]
    every = F.concat(*found) if found else F.array().cast("array<string>")
    return F.array_distinct(F.transform(every, text.strip) if trim else every)


def _role_contexts(patterns: Sequence[str], margin: int = ROLE_MARGIN) -> Column:
    """First lines of the surroundings of every role hit.

    The text is cut at its hits. A hit's surroundings then come from the few neighbouring pieces
    that can lie within ``margin`` characters, each trimmed to that length, so the work is linear.
    """
    if not patterns:
        return F.array().cast("array<string>")
    pattern = rx.any_of(patterns)
    none = F.array().cast("array<string>")

    def contexts(bound: Column) -> Column:
        hits, gaps = bound["hits"], bound["gaps"]
        trimmed = F.struct(
            hits.alias("hits"),
            F.transform(gaps, lambda g: F.right(g, F.lit(margin))).alias("ends"),
            F.transform(gaps, lambda g: F.left(g, F.lit(margin))).alias("starts"),
            F.array_min(F.transform(hits, lambda h: F.length(h))).alias("shortest"),
        )

        def pieces(t: Column) -> Column:
            return F.struct(
                t["hits"].alias("hits"), t["ends"].alias("ends"), t["starts"].alias("starts"),
                # The gap before a hit with the hit, and the hit with the gap after it.
                F.transform(t["hits"], lambda h, i: F.concat(F.get(t["ends"], i), h)).alias("lead"),
                F.transform(t["hits"], lambda h, i: F.concat(h, F.get(t["starts"], i + 1))).alias("tail"),
                F.ceil(F.lit(margin) / t["shortest"]).cast("int").alias("reach"),
            )

        def around(p: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                first = F.greatest(F.lit(0), i - p["reach"])
                before = F.concat(F.array_join(F.slice(p["lead"], first + 1, i - first), ""), F.get(p["ends"], i))
                after = F.concat(
                    F.get(p["starts"], i + 1), F.array_join(F.slice(p["tail"], i + 2, p["reach"]), "")
                )
                window = F.concat(F.right(before, F.lit(margin)), hit, F.left(after, F.lit(margin)))
                return F.substring_index(text.strip(window), "\n", 1)

            return F.transform(p["hits"], one)

        # Bound one after the other: a lambda would evaluate an unbound list again for every hit.
        found = text.bind(trimmed, lambda t: text.bind(pieces(t), around))
        return F.when(F.size(hits) > 0, found).otherwise(none)

    # One search: hits are marked, and the marks then part hits from gaps. A text that holds the mark is searched twice.
    marked = F.split(F.regexp_replace("content", F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    once = text.bind(marked, lambda pieces: F.struct(
        F.filter(pieces, lambda _, i: i % 2 == 1).alias("hits"), F.filter(pieces, lambda _, i: i % 2 == 0).alias("gaps")))
    twice = F.struct(
        F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("hits"),
        F.split("content", pattern, -1).alias("gaps"),
    )
    cut = F.when(F.contains("content", F.lit(MARK)), twice).otherwise(once)
    contexts_of_text = F.array_distinct(text.bind(cut, contexts))
    return F.when(rx.possible(F.col("content"), patterns), contexts_of_text).otherwise(none)


def _languages(framework: Column, catalogue: Catalogue) -> Column:
    pairs = [F.lit(v) for item in catalogue.framework_languages.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), framework), F.lit("unknown"))


def _items(catalogue: Catalogue, kinds: Iterable[str] = KINDS) -> Column:
    """What a file holds, as (kind, place, hit): its framework, its path per kind of authentication, its matches.

    Routes and models are searched by the patterns of every language, each as a kind of its own: the
    language of a project follows from all its files and then chooses among the kinds. Only ``kinds`` are searched.
    """
    auth, lists = {}, {}
    if "auth" in kinds:
        auth = {f"auth_{c}": rx.found(F.col("content"), p) for c, p in catalogue.auth.items()}
    if "routes" in kinds:
        lists |= {f"routes:{name}": _hits(p, trim=False) for name, p in catalogue.routes.items()}
    if "models" in kinds:
        lists |= {f"models:{name}": _hits(p, trim=True) for name, p in catalogue.models.items()}
    if "roles" in kinds:
        lists["roles"] = _role_contexts(catalogue.roles)

    def item(kind: Column, place: Column, hit: Column) -> Column:
        return F.struct(kind.alias("kind"), place.alias("place"), hit.alias("hit"))

    def of_list(kind: str, hits: Column) -> Column:
        return F.transform(hits, lambda hit, place: item(F.lit(kind), place, hit))

    framework = _first_framework(catalogue) if {"framework", "routes", "models"} & set(kinds) else F.lit(None).cast("string")
    found = F.array_compact(F.array(*[F.when(holds, F.lit(kind)) for kind, holds in auth.items()]).cast("array<string>"))

    def named(kinds: Column) -> Column:
        every = F.when(F.size(kinds) > 0, F.concat(kinds, F.array(F.lit("auth")))).otherwise(kinds)
        return F.transform(every, lambda kind: item(kind, F.lit(0), F.col("path")))

    # Lists of at most one, and bound lists: what is searched is named once, as every mention would search again.
    return F.concat(
        F.transform(F.array_compact(F.array(framework)), lambda name: item(F.lit("framework"), F.lit(0), name)),
        text.bind(found, named),
        *[of_list(kind, hits) for kind, hits in lists.items()],
    )


def project_features(
    files: DataFrame,
    catalogue: Catalogue = DEFAULT_CATALOGUE,
    limit: int | None = vocab.SAMPLE_FILES,
    candidates: DataFrame | None = None,
    kinds: Iterable[str] = KINDS,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Everything the context needs, one row per project of ``files``; ``kinds`` leaves out searches whose columns are not used.

    Texts are read and searched once. What a file holds is exploded and reduced to the first place of each
    distinct hit, partly before the shuffle; texts enter no window and no list. The lists of distinct hits
    are assembled last, from short rows, so their size follows from what a project holds and not from its
    texts. With ``candidates``, (project, path) or (file), only the texts of those files are searched: pass the files
    that a pattern can match, as :func:`auditweave.operators.search_index.candidates` or ``candidate_keys`` finds them.
    With ``projects`` (project), each once, only these are built; the other files are counted but neither moved nor searched.
    """
    sampled = sample_files(files, limit)
    if projects is not None:
        sampled = lookup_join(sampled, projects, "project", "left_semi", spread=["path"])
    if candidates is not None and candidates.columns == ["file"]:
        sampled = files_of(sampled, candidates)
    elif candidates is not None:
        sampled = lookup_join(sampled, candidates, ["project", "path"], "left_semi", spread=["path"])
    exploded = sampled.select("project", "path", F.explode(_items(catalogue, kinds)).alias("_item"))
    distinct = exploded.groupBy("project", F.col("_item.kind").alias("kind"), F.col("_item.hit").alias("hit")).agg(
        F.min(F.struct("path", F.col("_item.place").alias("place"))).alias("first"))

    whole = ~F.col("kind").startswith("auth_") & (F.col("kind") != "framework")
    found = distinct.groupBy("project").agg(
        F.min(F.when(F.col("kind") == "framework", F.struct("first", "hit")))["hit"].alias("_framework"),
        F.struct(*[F.count_if(F.col("kind") == f"auth_{c}").alias(c) for c in catalogue.auth]).alias("auth_counts"),
        F.sort_array(F.collect_list(F.when(whole, F.struct("kind", "first", "hit")))).alias("_found"),
    )
    zero = F.lit(0).cast("long")
    language = F.when(F.col("_framework").isNull(), F.col("manifest_language")).otherwise(_languages(F.col("_framework"), catalogue))

    def listed(kind: Column) -> Column:
        hits = F.transform(F.filter("_found", lambda x: x["kind"] == kind), lambda x: x["hit"])
        return F.coalesce(hits, F.array().cast("array<string>"))

    def of_language(kind: str, names: Iterable[str]) -> Column:
        name = F.when(F.col("language").isin(list(names)), F.col("language")).otherwise(F.lit(DEFAULT_LANGUAGE))
        return listed(F.concat(F.lit(f"{kind}:"), name)).alias(kind)

    # One pass over the paths; files without a project are in no sample.
    count = F.count_if(is_admitted() & F.col("project").isNotNull())
    count = (count if limit is None else F.least(count, F.lit(limit).cast("long"))).alias("files_sampled")
    every = manifest_languages(files, catalogue, [count])
    if projects is not None:
        every = every.join(projects, "project", "left_semi")
    rows = every.join(found, "project", "left")
    return rows.withColumn("language", language).select(
        "project", F.coalesce("_framework", F.lit("unknown")).alias("framework"), "language",
        "files_sampled",
        F.coalesce("auth_counts", F.struct(*[zero.alias(c) for c in catalogue.auth])).alias("auth_counts"),
        listed(F.lit("auth")).alias("auth_files"), of_language("routes", catalogue.routes), of_language("models", catalogue.models),
        listed(F.lit("roles")).alias("roles"),
    )


def auth_summary(categories: Sequence[str]) -> Column:
    lines = [
        F.when(
            F.col(f"auth_counts.{c}") > 0,
            F.concat(F.lit(f"  - {c}: found in "), F.col(f"auth_counts.{c}"), F.lit(" file(s)")),
        )
        for c in categories
    ]
    found = F.concat_ws("\n", *lines)
    return F.when(found == "", F.lit(NO_AUTH)).otherwise(F.concat(F.lit(AUTH_TITLE + "\n"), found))


def build_snapshot(
    files: DataFrame,
    catalogue: Catalogue = DEFAULT_CATALOGUE,
    limit: int | None = vocab.SAMPLE_FILES,
    candidates: DataFrame | None = None,
    projects: DataFrame | None = None,
) -> DataFrame:
    """The security context, one row per project; see :func:`project_features` for ``candidates`` and ``projects``."""
    features = project_features(files, catalogue, limit, candidates, projects=projects)
    return features.select(
        "project", "framework", "language",
        auth_summary(list(catalogue.auth)).alias("auth_summary"),
        "routes", "models", "roles",
        F.filter("auth_files", text.guards_access).alias("middleware"),
    )


def empty_snapshot(projects: DataFrame) -> DataFrame:
    """The context of projects about which nothing is known."""
    none = F.array().cast("array<string>")
    return projects.select("project").distinct().select(
        "project", F.lit("unknown").alias("framework"), F.lit("unknown").alias("language"),
        F.lit(NO_AUTH).alias("auth_summary"),
        *[none.alias(c) for c in ("routes", "models", "roles", "middleware")],
    )


def render_context(max_tokens: int = vocab.CONTEXT_TOKENS) -> Column:
    """The context as text for a prompt, cut at four characters per token."""

    def section(title: str, column: str, count_rest: bool) -> Column:
        shown = SHOWN[column]
        listed = F.transform(F.slice(column, 1, shown), lambda x: F.concat(F.lit("  "), x))
        rest = F.concat(F.lit("  ... and "), (F.size(column) - shown).cast("string"), F.lit(" more"))
        parts = [F.array(F.lit(title)), listed]
        if count_rest:
            parts.append(F.when(F.size(column) > shown, F.array(rest)).otherwise(F.array().cast("array<string>")))
        parts.append(F.array(F.lit("")))
        return F.when(F.size(column) > 0, F.concat(*parts)).otherwise(F.array().cast("array<string>"))

    lines = F.concat(
        F.array(
            F.lit(CONTEXT_TITLE),
            F.concat(F.lit("Framework: "), F.col("framework")),
            F.concat(F.lit("Language: "), F.col("language")),
            F.lit(""), F.lit("AUTHENTICATION:"), F.col("auth_summary"), F.lit(""),
        ),
        section(f"ROUTES (first {SHOWN['routes']}):", "routes", True),
        section(f"DATA MODELS (first {SHOWN['models']}):", "models", True),
        section("ROLES/PERMISSIONS:", "roles", False),
        section("AUTH MIDDLEWARE:", "middleware", False),
    )
    room = max_tokens * 4

    def cut(whole: Column) -> Column:
        short = F.concat(F.substring(whole, 1, room), F.lit(TRUNCATED))
        return F.when(F.length(whole) > room, short).otherwise(whole)

    return text.bind(F.array_join(lines, "\n"), cut)


def rendered_contexts(snapshot: DataFrame, max_tokens: int = vocab.CONTEXT_TOKENS) -> DataFrame:
    """``project, context`` only: rows of bounded width for the join with chunks."""
    return snapshot.select("project", render_context(max_tokens).alias("context"))


def context_overview(snapshot: DataFrame) -> DataFrame:
    """Counts and the first entries of each project's context, for display."""
    return snapshot.select(
        "project", "framework", "language",
        F.substring("auth_summary", 1, OVERVIEW_AUTH_CHARS).alias("auth_summary"),
        *[F.size(c).alias(f"{c}_found") for c in ("routes", "models", "roles")],
        *[F.slice(c, 1, n).alias(c) for c, n in OVERVIEW_SHOWN.items()],
    )


def context_json(snapshot: DataFrame) -> DataFrame:
    """The whole context of each project as one JSON object."""
    fields = ("framework", "language", "auth_summary", "routes", "models", "roles", "middleware")
    return snapshot.select("project", F.to_json(F.struct(*fields)).alias("context_json"))


def refresh_snapshot(stored: DataFrame, files: DataFrame, changed: DataFrame | None = None, manifest: DataFrame | None = None, **options) -> DataFrame:
    """Rebuild the contexts of the ``changed`` projects and keep the stored rows of all others.

    Instead of naming the changed projects, pass the ``manifest`` of the files that ``stored`` was built from (see
    :func:`auditweave.operators.manifest.file_manifest`): projects whose digest differs are rebuilt, projects
    without any file left lose their row.
    """
    if (changed is None) == (manifest is None):
        raise ValueError("name the changed projects or give the manifest of the stored snapshot")
    if changed is None:
        # Stored, since every read of the files below would make the digests of all texts once more.
        changed = stored_once(changed_projects(manifest, file_manifest(files)).select("project"), "changed")
    names = changed.select("project").distinct()
    kept = lookup_join(stored, names, "project", "left_anti", spread=["framework"])
    return kept.unionByName(build_snapshot(files, projects=names, **options))
