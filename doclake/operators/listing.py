"""Listings, trees and bundles of many files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.detect import file_ext
from doclake.functions.text import let
from doclake.operators.ordering import with_next, with_position, with_running_sum
from doclake.rules import ARCHIVE_EXTENSIONS, CODE_EXTENSIONS, CONFIG_EXTENSIONS, rule_table
from doclake.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)


def ext_category(df: DataFrame, path: str, is_dir: str) -> DataFrame:
    """Adds ``category``: folder, plain, code, config, archive or text. A dot-only name stands for its own extension."""
    name = F.substring_index(F.col(path), "/", -1)
    ext = F.when(file_ext(F.col(path)) != "", file_ext(F.col(path))).otherwise(
        F.when(F.contains(name, F.lit(".")), F.replace(name, F.lit("."), F.lit(""))).otherwise(""))
    # an extension listed twice belongs to the first category
    rows = {e: c for c, exts in reversed([("code", CODE_EXTENSIONS), ("config", CONFIG_EXTENSIONS),
                                          ("archive", ARCHIVE_EXTENSIONS)]) for e in exts}
    rules = F.broadcast(rule_table(df.sparkSession, sorted(rows.items()), "_rule, _category"))
    return df.withColumn("_ext", ext).join(rules, F.col("_ext") == F.col("_rule"), "left").withColumn(
        "category", F.when(F.col(is_dir), "folder").when(F.col("_ext") == "", "plain").otherwise(
            F.coalesce("_category", F.lit("text")))).drop("_ext", "_rule", "_category")


def list_sorted(df: DataFrame, path: str, is_dir: str, size: str, modified: str, mode: str = "name",
                reverse: bool = False) -> DataFrame:
    """Adds ``position``: folders first (last when reversed), then by name, size, time, or type and name."""
    name = F.lower(F.col(path))
    keys = {"name": [name], "size": [F.coalesce(F.col(size), F.lit(0))], "time": [F.col(modified)],
            "type": [file_ext(F.col(path)), name]}[mode]
    direction = (lambda c: c.desc()) if reverse else (lambda c: c.asc())
    folders = F.when(F.col(is_dir), 0).otherwise(1)
    return with_position(df, direction(folders), *[direction(k) for k in keys], F.col(path))


def grid_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Adds ``grid_row`` and ``grid_col``: consecutive items in rows of ``n``."""
    placed = with_position(df, *order, name="_at")
    return placed.withColumn("grid_row", F.floor(F.col("_at") / n).cast("bigint")).withColumn(
        "grid_col", (F.col("_at") % n).cast("int")).drop("_at")


def path_parts(path: Column) -> Column:
    """Components of a path; an address with ``://`` is a single one."""
    return F.when(F.contains(path, F.lit("://")), F.array(path)).otherwise(F.split(path, "/"))


def common_root(df: DataFrame, group: str, path: str) -> DataFrame:
    """Longest folder all paths of a group share: the common start of the smallest and the largest folder."""
    parts = path_parts(F.col(path))
    folder = F.slice(parts, 1, F.size(parts) - 1)
    ends = df.groupBy(group).agg(F.min(folder).alias("lo"), F.max(folder).alias("hi"))
    upto = F.array_position(F.concat(F.transform(
        F.arrays_zip("lo", "hi"), lambda z: ~z["lo"].eqNullSafe(z["hi"])), F.array(F.lit(True))), True) - 1
    return ends.select(group, F.array_join(F.slice("lo", 1, upto.cast("int")), "/").alias("root"))


def tree_nodes(df: DataFrame, group: str, path: str) -> DataFrame:
    """``group, parts, is_file`` of every file and every folder above one."""
    parts = path_parts(F.col(path))
    whole = df.select(F.col(group).alias("group_key"), parts.alias("whole"))
    nodes = whole.select("group_key", "whole", F.explode(F.sequence(F.lit(1), F.size("whole"))).alias("depth"))
    return nodes.select("group_key", F.slice("whole", 1, F.col("depth")).alias("parts"),
                        (F.col("depth") == F.size("whole")).alias("leaf")).groupBy("group_key", "parts").agg(
                            F.max("leaf").alias("is_file"))


def file_tree(df: DataFrame, group: str, path: str) -> DataFrame:
    """One row per drawn line: ``group_key, parts, is_file, line``; sort by (group_key, parts) to print.

    A node is last when its name is the greatest in its folder, which is a map-side combined maximum instead of a
    window over the folder; every node then asks each folder above it, and a crowded folder is only the probe side of a
    join with unique keys, which the adaptive skew join splits.
    """
    nodes = tree_nodes(df, group, path)
    last = nodes.groupBy("group_key", F.expr("slice(parts, 1, size(parts) - 1)").alias("folder")).agg(
        F.max(F.element_at("parts", -1)).alias("last_name"))
    asked = nodes.select("group_key", "parts", "is_file", F.explode(F.expr("sequence(1, size(parts))")).alias("k")).select(
        "*", F.expr("slice(parts, 1, k - 1)").alias("folder"), F.expr("parts[k - 1]").alias("name"))
    flags = asked.join(last, ["group_key", "folder"]).groupBy("group_key", "parts").agg(
        F.first("is_file").alias("is_file"),
        F.sort_array(F.collect_list(F.struct("k", (F.col("name") == F.col("last_name")).alias("is_last")))).alias("flags"))
    line = F.expr("""concat(
        array_join(transform(slice(flags, 1, size(flags) - 1), f -> if(f.is_last, '    ', '│   ')), ''),
        if(element_at(flags, -1).is_last, '└── ', '├── '), element_at(parts, -1), if(is_file, '', '/'))""")
    return flags.select("group_key", "parts", "is_file", line.alias("line"))


def path_listing(df: DataFrame, path: str) -> DataFrame:
    """Flat listing of files and folders with ``depth``, ``is_last`` and the drawn ``line``.

    A row is last when the next row in path order is shallower; paths are one global sequence, so the look-ahead uses
    range partitions and their edges rather than one big window.
    """
    parts = path_parts(F.col(path))
    rows = df.select(F.col(path).alias("path")).distinct()
    rows = rows.withColumn("depth", F.size(path_parts(F.col("path"))) - 1)
    rows = with_next(rows, F.col("depth"), path_parts(F.col("path")), name="next_depth")
    name = F.element_at(path_parts(F.col("path")), -1)
    last = F.coalesce(F.col("next_depth") < F.col("depth"), F.lit(True)) & (F.col("depth") > 0)
    guide = F.when(F.col("depth") == 0, "").otherwise(F.concat(
        F.expr("repeat('│   ', depth - 1)"), F.when(F.col("is_last"), "└── ").otherwise("├── ")))
    return rows.withColumn("is_last", last).select("path", "depth", "is_last", F.concat(guide, name).alias("line"))


def bundle_documents(df: DataFrame, group: str, path: str, content: str, version: Column) -> DataFrame:
    """A bundle as ordered rows ``group_key, section, parts, text``: tree header, tree lines, then one row per file.

    Of two contents for one path the later ``version`` wins. Concatenating ``text`` in (section, parts) order gives the
    bundle; a group never has to fit in one string or one task. The input is read once: what is kept of it is written to the
    checkpoint folder, from where the tree takes the paths and the sections the contents.
    """
    files = cut_lineage(df.groupBy(F.col(group).alias("group_key"), F.col(path).alias("path")).agg(F.max_by(F.col(content), version).alias("content")))
    tree = file_tree(files, "group_key", "path").select("group_key", F.lit(1).alias("section"), "parts", F.concat("line", F.lit("\n")).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    frame = F.array(F.struct(F.lit(0).alias("section"), F.lit("```file-tree\n").alias("text")), F.struct(F.lit(2).alias("section"), F.lit("```\n\n").alias("text")))
    ends = files.select("group_key").distinct().select("group_key", F.explode(frame).alias("f")).select("group_key", "f.section", none.alias("parts"), "f.text")
    sections = files.select("group_key", F.lit(3).alias("section"), F.array("path").alias("parts"), F.concat(
        F.lit("# File: "), "path", F.lit("\n\n"), "content", F.lit("\n\n")).alias("text"))
    return tree.unionByName(ends).unionByName(sections)


def concat_raw(df: DataFrame, group: str, order: Column, content: str) -> DataFrame:
    """Ordered concatenation, nothing added, as rows ``group, start, content``: ``start`` is the byte each content begins at.

    Writing the rows of a group in order of ``start`` gives the text, whatever its size; a null content is empty.
    """
    rows = df.select(F.col(group), order.alias("_order"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    placed = with_running_sum(rows, F.octet_length("content").cast("bigint"), F.col(group), F.col("_order"), name="start")
    return placed.select(group, "start", "content")


def join_rows(rows: DataFrame, group: str) -> DataFrame:
    """One text for each group of ``concat_raw``: ``group, content``. For groups that fit in one value."""
    # rows without bytes share a start and add nothing
    return rows.groupBy(group).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("start", "content"))), lambda s: s["content"]), "").alias("content"))


def select_covered(paths: DataFrame, selection: DataFrame) -> DataFrame:
    """Files named by ``selection(path)`` directly or through any folder above them, each once.

    Every file asks for its own path and its folders: an equi semi join instead of a prefix comparison of all pairs.
    """
    parts = F.split("path", "/")
    asked = paths.select("path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("prefix"))
    return asked.join(selection.select(F.col("path").alias("prefix")), "prefix", "left_semi").select("path").distinct()


def _glob_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regex for a path, negated, folders only) of one ignore pattern.

    A slash anywhere but at the end ties the pattern to its folder. ``**`` spans folders where it stands alone between
    slashes and is ``*`` elsewhere; a backslash takes the next character as it is. The regex means the same in Java and Python.
    """
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")

    def part(m: re.Match) -> str:
        t = m.group(0)
        if t in ("/**/", "**/", "/**"):
            return {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*"}[t]
        if t.startswith("*"):
            return "[^/]*"
        if t == "?":
            return "[^/]"
        if t.startswith("[") and len(t) > 1:
            inner = t[2:-1] if t[1] in "!^" else t[1:-1]
            return f"(?!/)[{'^' if t[1] in '!^' else ''}{re.sub(r'([^A-Za-z0-9_-])', _escaped, inner)}]"
        return _escaped(t[-1])

    out = re.sub(r"/\*\*/(?=.)|^\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|.", part, body, flags=re.S) if body != "**" else ".*"
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, only_dirs


def _escaped(c: re.Match | str) -> str:
    c = c if isinstance(c, str) else c.group(0)
    return c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c


def _rule_lines(content: str) -> list[str]:
    """Patterns of an ignore file, by line; empty where a line is none. Blanks at the end count where a backslash is before them."""
    lines = (re.sub(r"(?<!\\)[ \t\r]+$", "", line) for line in content.split("\n"))
    return ["" if line.startswith("#") else line for line in lines]


def ignore_filter(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Files not ignored: the last matching pattern decides, and nothing below an ignored folder comes back.

    The pattern list is part of the plan, so this is a projection with compiled patterns, not a join.
    """
    rules = [_glob_regex(p) for p in patterns if p.strip() and not p.startswith("#")]

    def ignored(prefix: Column, is_dir: Column) -> Column:
        decision = F.lit(None).cast("boolean")
        for regex, negated, only_dirs in rules:
            hit = F.rlike(prefix, F.lit(regex))
            decision = F.when(hit & is_dir if only_dirs else hit, F.lit(not negated)).otherwise(decision)
        return F.coalesce(decision, F.lit(False))

    parts = F.split(F.ltrim("path", F.lit("/")), "/")
    hidden = let(parts, lambda ps: F.exists(
        F.sequence(F.lit(1), F.size(ps)), lambda d: ignored(F.array_join(F.slice(ps, F.lit(1), d), "/"), d < F.size(ps))))
    return paths.filter(~hidden)


#: Names of ignore files; a match in one of a later name decides over those of earlier names, in whatever folder.
IGNORE_FILES = (".gitignore", ".ignore")


def _translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, rank, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "rank", "content"))):
            rows = [(n, *_glob_regex(line)) for n, line in enumerate(_rule_lines(content or "")) if line.strip("!/ ")]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(rows)), pa.array([rank] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()),
                     pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.bool_())], ["folder", "rank", "line", "regex", "negated", "only_dirs"])


def ignore_rules(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``folder, rules``: the patterns of every ignore file among ``files``, with the folder that they hold in (empty at the top).

    ``rules`` has one entry a line: rank of the file's name, line, regex, negated, only_dirs. Other files are not read.
    """
    name = F.substring_index(F.col(path), "/", -1)
    whole = F.ltrim(F.col(path), F.lit("/"))
    rank = F.array_position(F.array(*[F.lit(n) for n in IGNORE_FILES]), name).cast("int")
    found = files.where(name.isin(*IGNORE_FILES)).select(
        F.regexp_replace(whole, "/?[^/]*$", "").alias("folder"), rank.alias("rank"), F.col(content).cast("string").alias("content"))
    lines = found.mapInArrow(_translate, "folder string, rank int, line int, regex string, negated boolean, only_dirs boolean")
    return lines.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("rank", "line", "regex", "negated", "only_dirs"))).alias("rules"))


def ignore_by_rules(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``paths`` that no ignore file of the tree hides.

    Every file and every folder above one asks the rules of each folder above it, for its path below that folder. The last
    match decides: by name of the ignore file, then by depth of its folder, then by line. What lies below an ignored folder stays hidden
    whatever later rules say. Folders with rules are the unique side of the join, so a folder with very many files below it can be split.
    """
    whole = F.ltrim(F.col(path), F.lit("/"))
    parts = F.split(whole, "/")
    here = paths.select(whole.alias("file"), parts.alias("ps")).distinct()
    entries = here.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ps")), lambda d: F.struct(
        F.slice("ps", F.lit(1), d).alias("parts"), (d < F.size("ps")).alias("is_dir")))).alias("e"))
    entries = entries.groupBy("e.parts").agg(F.max("e.is_dir").alias("is_dir"))
    asked = entries.select("parts", "is_dir", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"))
    asked = asked.withColumn("folder", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).join(rules, "folder")
    below = F.array_join(F.slice("parts", F.col("depth") + 1, F.size("parts")), "/")

    def last_match(rest: Column) -> Column:
        hits = F.filter("rules", lambda r: F.rlike(rest, r["regex"]) & (F.col("is_dir") | ~r["only_dirs"]))
        return let(hits, lambda h: F.get(h, F.size(h) - 1))

    decided = asked.withColumn("hit", let(below, last_match)).where("hit is not null")
    decided = decided.groupBy("parts").agg(F.max_by("hit.negated", F.struct("hit.rank", "depth", "hit.line")).alias("kept"))
    hidden = decided.where("not kept").select(F.array_join("parts", "/").alias("entry"))
    up = here.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size("ps")), lambda d: F.array_join(F.slice("ps", F.lit(1), d), "/"))).alias("entry"))
    gone = up.join(hidden, "entry", "left_semi").select("file").distinct()
    return paths.withColumn("_file", whole).join(gone, F.col("_file") == F.col("file"), "left_anti").drop("_file")
