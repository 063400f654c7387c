"""The subject catalog: sections joined by subject, phases, and name matching (J1-J10, PF1-PF7, SO1, SO6, SE1-SE5, AG66-AG68)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

SUBJECT = "subject_id"
PHASES = ("training", "validation", "inference")
ALL = "all"


def join_sections(sections: list[DataFrame]) -> DataFrame:
    """J1, SC14: full outer join of sections on subject_id, folded left to right."""
    return reduce(lambda a, b: a.join(b, SUBJECT, "full"), sections)


def with_partition(catalog: DataFrame, partition: DataFrame) -> DataFrame:
    """Inner join with (subject_id, phase); a subject in two phases appears twice."""
    return catalog.join(partition, SUBJECT, "inner")


def phase_counts(catalog: DataFrame, partition: DataFrame) -> DataFrame:
    """Subjects of the catalog in each phase."""
    return with_partition(catalog.select(SUBJECT), partition).groupBy("phase").agg(F.count(SUBJECT).alias("n"))


def has_phase(catalog: DataFrame, partition: DataFrame, phase: str) -> bool:
    """Whether any subject of the catalog is in the phase."""
    return not catalog.join(partition.where(F.col("phase") == phase), SUBJECT, "left_semi").isEmpty()


def known_only(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose subject is in the catalog."""
    return rows.join(catalog.select(SUBJECT), SUBJECT, "left_semi")


def missing_subjects(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """J6, SE2: subjects of the catalog without a row."""
    return catalog.select(SUBJECT).join(rows.select(SUBJECT), SUBJECT, "left_anti")


def aligned(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """SC5: rows of known subjects; an error names up to five subjects that have none."""
    missing = [r[0] for r in missing_subjects(catalog, rows).limit(5).collect()]
    if missing:
        raise ValueError(f"subjects without rows: {missing}")
    return known_only(rows, catalog)


def file_list(catalog: DataFrame, partition: DataFrame | None = None, phase: str = ALL, sections: list[str] | None = None) -> DataFrame | None:
    """PF1, PF2, SO1: subject_id and the named sections of a phase, by subject; None for an empty phase."""
    unknown = set(sections or ()) - set(catalog.columns)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    rows = catalog.select(SUBJECT, *(sections or [c for c in catalog.columns if c != SUBJECT]))
    if phase != ALL:
        if phase not in PHASES:
            raise ValueError(f"unknown phase: {phase}")
        rows = with_partition(rows, partition.where(F.col("phase") == phase)).drop("phase")
        if rows.isEmpty():
            return None
    return rows.orderBy(SUBJECT)


def with_fallback(catalog: DataFrame, partition: DataFrame, phase: str) -> DataFrame:
    """PF3: the subjects of a phase, or all subjects where the phase is empty; one plan, no driver decision."""
    chosen = catalog.join(partition.where(F.col("phase") == phase).select(SUBJECT), SUBJECT, "inner")
    empty = partition.where(F.col("phase") == phase).join(catalog.select(SUBJECT), SUBJECT, "left_semi").agg((F.count("*") == 0).alias("__empty"))
    everyone = catalog.join(F.broadcast(empty), F.col("__empty")).drop("__empty")
    return chosen.unionByName(everyone)


def phases_for(action: str, phase: str | None = None, validation: bool = False) -> list[str]:
    """PF4: an explicit phase wins; training takes training (and validation), everything else inference."""
    if phase:
        return [phase]
    return ["training", *["validation"] * validation] if action == "train" else ["inference"]


def phases_column(action: Column, phase: Column, validation: Column) -> Column:
    """PF4 for columns: an array of phases."""
    own = F.when(validation, F.array(F.lit("training"), F.lit("validation"))).otherwise(F.array(F.lit("training")))
    return F.when(F.coalesce(phase, F.lit("")) != "", F.array(phase)).when(action == "train", own).otherwise(F.array(F.lit("inference")))


def searched_sections(sections: DataFrame) -> DataFrame:
    """PF17 for a table of sections (path_to_search, csv_file, csv_data_file): those with a path and no files of their own."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return sections.where(some("path_to_search") & ~some("csv_file") & ~some("csv_data_file"))


def complete_cases(catalog: DataFrame, sections: list[str]) -> DataFrame:
    """PF5: subjects with a non-empty value in every required section."""
    return catalog.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in sections)))


def require_values(catalog: DataFrame, sections: list[str]) -> None:
    """PF6: an error where a section has no value at all."""
    counts = catalog.agg(*[F.count(c).alias(c) for c in sections]).first()
    empty = [c for c in sections if not counts[c]]
    if empty:
        raise ValueError(f"empty sections: {empty}")


def grouped_sections(catalog: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """PF7: task name -> array of its sections."""
    return catalog.select(SUBJECT, *[F.array(*[F.col(c).cast("string") for c in cols]).alias(name) for name, cols in tasks.items()])


def portable_key(key: Column) -> Column:
    """An order key that any SQL engine computes alike: a linear congruential step on an integer id."""
    return (key.cast("long") * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)


def random_split(subjects: DataFrame, key: str, validation: float, inference: float) -> DataFrame:
    """SO6: (key, phase) by ranks of a portable pseudo-random order.

    n_valid = ceil(N * validation) and n_infer = ceil(N * inference), ratios clamped to [0, 1]; ranks run training,
    validation, inference, so that an overflow cuts inference first. Ranks come from a range partition and the counts
    of its parts, not from a window over one partition, so no task takes all rows.
    """
    v, i = min(max(validation, 0.0), 1.0), min(max(inference, 0.0), 1.0)
    ranked = global_rank(subjects.select(key), [portable_key(F.col(key)), F.col(key)])
    n = F.col("__n")
    total = ranked.agg(F.count("*").alias("__n"))
    rows = ranked.join(F.broadcast(total))
    n_valid, n_infer = F.ceil(n * v), F.ceil(n * i)
    n_train = F.greatest(n - n_valid - n_infer, F.lit(0))
    phase = F.when(F.col("rank") <= n_train, "training").when(F.col("rank") <= n_train + n_valid, "validation").otherwise("inference")
    return rows.select(key, phase.alias("phase"))


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `rank` 1, 2, ... in the given total order, without a single-partition window.

    Rows are range-partitioned by the order, numbered inside each part, and shifted by the counts of the parts before.
    The parts are checkpointed: their bounds come from a sample, which a second evaluation would draw anew.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keyed.repartitionByRange(parts, *names).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*names))
    return placed.withColumn("rank", inner).join(F.broadcast(base), "__part").withColumn("rank", F.col("rank") + F.col("__base")).drop("__part", "__base", *names)


def label_map(df: DataFrame, column: str) -> DataFrame:
    """AG66, SE4: distinct non-null labels in order, mapped to 0, 1, ..."""
    return global_rank(df.where(F.col(column).isNotNull()).select(column).distinct(), [F.col(column)]).select(column, (F.col("rank") - 1).cast("int").alias("code"))


def relabel(df: DataFrame, column: str, mapping: DataFrame, name: str, missing: int = 0) -> DataFrame:
    """F-M6: labels by their code; unmapped labels become `missing`."""
    codes = mapping.select(F.col(mapping.columns[0]).alias("__k"), F.col(mapping.columns[1]).alias("__v"))
    return df.join(codes, df[column].eqNullSafe(codes["__k"]), "left").withColumn(name, F.coalesce("__v", F.lit(missing))).drop("__k", "__v")


def unlabel(df: DataFrame, code: str, mapping: DataFrame, name: str) -> DataFrame:
    """F-M6 inverse: labels of the codes."""
    back = mapping.select(F.col(mapping.columns[1]).alias("__k"), F.col(mapping.columns[0]).alias(name))
    return df.join(back, df[code] == back["__k"], "left").drop("__k")


def without_duplicates(df: DataFrame, name: str) -> DataFrame:
    """AG67: rows whose name occurs once."""
    once = df.groupBy(name).agg(F.count("*").alias("__n")).where("__n = 1")
    return df.join(once.select(name), name, "left_semi")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """AG68: ids that break uniqueness, with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """SE1: whether both tables hold the same set of ids."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SE5: rows of both tables by key, those of `new` winning."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_degree(left: DataFrame, right: DataFrame) -> DataFrame:
    """For rows (id, candidates array) on both sides, the first exact hit in candidate order."""
    a = left.select(F.col("id").alias("left_id"), F.posexplode("candidates").alias("i", "name"))
    b = right.select(F.col("id").alias("right_id"), F.posexplode("candidates").alias("j", "name"))
    w = Window.partitionBy("left_id").orderBy("i", "j", "right_id")
    return a.join(b, "name").withColumn("k", F.row_number().over(w)).where("k = 1").select("left_id", "right_id", "name")


def longest_common_substring(a: Column, b: Column) -> Column:
    """F-S5: length of the longest substring of a that is in b."""
    n = F.length(a)
    here = lambda i: F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.when(F.contains(b, F.substring(a, i, k)), k).otherwise(0))), F.lit(0))
    return F.when((n > 0) & (F.length(b) > 0), F.array_max(F.transform(F.sequence(F.lit(1), n), here))).otherwise(0)


def _suffixes(df: DataFrame, name: str) -> DataFrame:
    """A row for each suffix `s` of a name: as many as it has characters."""
    c = F.col(name)
    return df.where(F.length(c) > 0).withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c)))))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of characters that two strings begin with alike; 0 where one is null."""
    ends = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    alike = F.aggregate(ends, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, 1) == F.substring(b, i, 1)), i).otherwise(n))
    return F.when(a.isNull() | b.isNull() | (F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(alike)


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows (s, distinct, and a boolean mark) with the nearest marked s before or at it and after or at it.

    Rows are range-partitioned by s and numbered by part; inside a part windows look back and forth, and what a part has
    to hand on, its last and its first marked s, is one row a part.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, "s").withColumn("__part", F.spark_partition_id()))
    marked = F.when(F.col("mark"), F.col("s"))
    inside = {n: Window.partitionBy("__part").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for n, o in (("before", F.asc("s")), ("after", F.desc("s")))}
    edges = placed.groupBy("__part").agg(F.max(marked).alias("__last"), F.min(marked).alias("__first"))
    over = {n: Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for n, o in (("before", F.asc("__part")), ("after", F.desc("__part")))}
    edges = edges.select("__part", F.last("__last", ignorenulls=True).over(over["before"]).alias("__b"), F.last("__first", ignorenulls=True).over(over["after"]).alias("__a"))
    found = placed.select("*", *[F.last(marked, ignorenulls=True).over(w).alias(n) for n, w in inside.items()]).join(F.broadcast(edges), "__part")
    return found.select(*rows.columns, F.coalesce("before", "__b").alias("before"), F.coalesce("after", "__a").alias("after"))


def fuzzy_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, size): the right name with the longest common substring, ties by size / length of it;
    a left name whose best is shared by several right rows is ambiguous and left out, and so is one without a match.

    left and right: (id, name). Suffixes of both sides are sorted together: what a left suffix shares with any right name
    it shares with the right suffix next to it, so its longest match is a common prefix of neighbours. The substrings
    that are longest for some left name are then placed among the right suffixes: a suffix belongs to the deepest of
    them that it begins with, and what is known of these (the shortest names, with their first and last id: two tell a
    tie) is handed up to the substrings that they begin with. Rows are as many as characters; equal suffixes are one row.
    """
    a = _suffixes(left.select(F.col("id").alias("left_id"), F.col("name").alias("a")), "a").select("left_id", "s")
    b = _suffixes(right.select(F.col("id").alias("right_id"), F.col("name").alias("b")), "b")
    ends = b.groupBy("s").agg(F.min(F.struct(F.length("b").alias("n"), F.col("right_id").alias("id"))).alias("x"), F.max(F.struct((-F.length("b")).alias("n"), F.col("right_id").alias("id"))).alias("y"))
    sorted_ = a.select("s", F.lit(False).alias("mark")).unionByName(ends.select("s", F.lit(True).alias("mark"))).groupBy("s").agg(F.max("mark").alias("mark"))
    size = F.greatest(common_prefix(F.col("s"), F.col("before")), common_prefix(F.col("s"), F.col("after")))
    sized = cut(a.join(_neighbours(sorted_).select("s", size.alias("size")), "s").where("size > 0"))
    longest = sized.groupBy("left_id").agg(F.max("size").alias("size"))
    best = sized.join(longest, ["left_id", "size"]).select("left_id", "size", F.left("s", F.col("size")).alias("g")).distinct()

    wanted = best.select("g").distinct()
    prefixes = wanted.select(F.col("g").alias("of"), F.explode(F.sequence(F.lit(1), F.length("g"))).alias("k")).withColumn("g", F.left("of", F.col("k")))
    prefixes = prefixes.join(wanted, "g")
    chain = prefixes.groupBy("of").agg(F.collect_list("k").alias("ks"))
    placed = ends.select("s", F.lit(False).alias("mark")).unionByName(wanted.select(F.col("g").alias("s"), F.lit(True).alias("mark"))).groupBy("s").agg(F.max("mark").alias("mark"))
    near = _neighbours(placed).select("s", F.col("before").alias("of")).join(chain, "of")
    shared = common_prefix(F.col("s"), F.col("of"))
    deepest = near.withColumn("c", shared).withColumn("k", F.array_max(F.filter("ks", lambda k: k <= F.col("c")))).where("k > 0").select("s", F.left("of", F.col("k")).alias("of"))
    held = ends.join(deepest, "s").groupBy("of").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    known = held.join(prefixes.select("of", "g"), "of").groupBy("g").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    found = best.join(known, "g").groupBy("left_id").agg(F.min("x").alias("first"), F.max("y").alias("last"), F.max("size").alias("size"))
    return found.where("first.id = last.id").select("left_id", F.col("first.id").alias("right_id"), F.col("size").cast("int").alias("size"))


def second_degree(left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact matches of (id, candidates), and fuzzy ones on first candidates for the rest."""
    exact = first_degree(left, right).select("left_id", "right_id")
    rest = left.join(exact.select(F.col("left_id").alias("id")), "id", "left_anti").select("id", F.col("candidates")[0].alias("name"))
    free = right.join(exact.select(F.col("right_id").alias("id")), "id", "left_anti").select("id", F.col("candidates")[0].alias("name"))
    return exact.unionByName(fuzzy_match(rest, free).select("left_id", "right_id"))


def match_all(lists: list[DataFrame]) -> DataFrame:
    """Every list (id, candidates) matched against the longest one (the first of equals): a row for each of its ids
    with the partners id_<k> in all lists, its own in its place; no partner gives null."""
    sizes = [x.count() for x in lists]
    longest = sizes.index(max(sizes))
    out = lists[longest].select(F.col("id").alias(f"id_{longest}"))
    for k, other in enumerate(lists):
        if k != longest:
            found = second_degree(lists[longest], other).select(F.col("left_id").alias(f"id_{longest}"), F.col("right_id").alias(f"id_{k}"))
            out = out.join(found, f"id_{longest}", "left")
    return out.select(*[f"id_{k}" for k in range(len(lists))])


def matched_rows(matched: DataFrame) -> DataFrame:
    """J10, as written to a catalog: rows with a partner in every list."""
    return matched.na.drop("any")
