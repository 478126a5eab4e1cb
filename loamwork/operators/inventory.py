"""Classification of files and the inventory of a tree: costs by tier and directory, and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glob import EXCLUDE_DEFAULTS, VENDOR_DEFAULTS, classify, compile_rules
from ..functions.paths import ancestors, language

# The limits that advice names.
MANY_FILES, MANY_BYTES, LARGE_FILE = 10_000, 100 * 1024 * 1024, 10 * 1024 * 1024
TOP = 20
# Names of directories that hold dependencies, build results or environments.
PROBLEM_DIRECTORIES = ("node_modules", "vendor", "target", "dist", "build", ".direnv", "venv", ".venv", "__pycache__", ".next")


def layered(*layers: tuple[str, list[str]]) -> list[dict]:
    """Rules of all layers in order, each with its origin and place there; later ones win when they are matched."""
    return [{"origin": origin, "position": k, "rule": rule} for origin, rules in layers for k, rule in enumerate(rules)]


def classified(files: DataFrame, exclude: list[str] | tuple[str, ...] = EXCLUDE_DEFAULTS, vendor: list[str] | tuple[str, ...] = VENDOR_DEFAULTS, path_col: str = "path", strict: bool = True) -> DataFrame:
    """files with `decision` (drop, tier1, tier2) and `language`."""
    return files.withColumns({"decision": classify(F.col(path_col), compile_rules(exclude, strict), compile_rules(vendor, strict)), "language": language(F.col(path_col))})


def admitted(files: DataFrame, *keep: str) -> DataFrame:
    """Files (path, content binary) that can be indexed: up to LARGE_FILE bytes, no NUL, valid UTF-8; adds source, size, hash and the columns in keep."""
    fits = files.where((F.octet_length("content") <= LARGE_FILE) & F.is_valid_utf8(F.col("content").cast("string")))
    source = F.col("content").cast("string")
    return fits.where(F.instr(source, "\x00") == 0).select("path", source.alias("source"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_hash"), *keep)


def tiers(decided: DataFrame) -> DataFrame:
    """files and bytes of each decision."""
    return decided.groupBy("decision").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def directory_costs(decided: DataFrame) -> DataFrame:
    """path, files, bytes: what each directory holds at any depth, of the selected files."""
    return decided.where("decision <> 'drop'").select(F.explode(ancestors(F.col("path"))).alias("path"), "size").groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def largest_files(decided: DataFrame, top: int = TOP) -> DataFrame:
    return decided.where("decision <> 'drop'").select("path", F.col("size").alias("bytes")).orderBy(F.desc("bytes"), F.hex("path")).limit(top)


def costly_directories(decided: DataFrame, top: int = TOP) -> DataFrame:
    return directory_costs(decided).orderBy(F.desc("bytes"), F.desc("files"), "path").limit(top)


def advice(decided: DataFrame, problem_directories: list[str] | None = None, complete: bool = True, unreadable: int = 0) -> DataFrame:
    """One row: files, bytes, largest, problems (selected files below a directory of these names), reasons (array) and
    advice on a selection, candidate_exclusions (a rule for each such name) and counts_are_lower_bounds."""
    names = list(problem_directories or PROBLEM_DIRECTORIES)
    above = F.transform(ancestors(F.col("path")), lambda p: F.element_at(F.split(p, "/"), -1))
    found = F.array_intersect(above, F.array(*[F.lit(x) for x in names]))
    decided = decided.withColumn("found", found)
    bad = F.size("found") > 0
    sums = decided.where("decision <> 'drop'").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(bad).alias("problems"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("names"))
    reasons = F.array_compact(F.array(
        F.when(F.col("files") > MANY_FILES, "selected_files_over_10000"), F.when(F.col("bytes") > MANY_BYTES, "selected_bytes_over_100_mib"),
        F.when(F.col("largest") > LARGE_FILE, "file_exceeds_indexer_10_mib_limit"), F.when(F.col("problems") > 0, "selected_dependency_build_or_environment_directory"),
        F.lit(None if complete else "incomplete_inventory").cast("string"), F.lit("unreadable_entries" if unreadable else None).cast("string"),
    ))
    return sums.withColumn("reasons", reasons).withColumn("advice", F.when(F.size("reasons") > 0, "refine_configuration_with_or_without_agent").otherwise("ready")).withColumns(
        {"candidate_exclusions": F.transform(F.sort_array("names"), lambda x: F.concat(F.lit("**/"), x, F.lit("/"))), "counts_are_lower_bounds": F.lit(not complete)}
    ).drop("names")
