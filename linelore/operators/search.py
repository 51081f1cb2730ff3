"""Groups of matches, paths and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linelore.functions import text as T

# Folders whose matches are noise, in the order in which they are looked for. Fixed values.
NOISE_DIRS = (".git", ".next", ".turbo", ".cache", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor")


def normal_path(path: Column) -> Column:
    """Slashes forward and single, without ``./`` in front and slashes behind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.trim(path), r"\\\\", "/"), r"^\./", ""), "/{2,}", "/"), "/+$", "")


def noise_bucket(path: Column) -> Column:
    """The first noisy folder of a path, else null."""
    dirs = F.filter(F.split(normal_path(path), "/"), lambda x: x.isin(*NOISE_DIRS))
    return F.get(dirs, F.lit(0))


def matches(df: DataFrame, file: str, text: str, pattern: str) -> DataFrame:
    """``file, line_no, line``: the lines of each text that match."""
    e = df.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("p", "line"))
    return e.where(F.col("line").rlike(pattern)).select("file", (F.col("p") + 1).alias("line_no"), "line")


def group_by_file(m: DataFrame, most: int = 160) -> DataFrame:
    """``file, n, first_line, text``: matches of each file with its first."""
    return m.groupBy("file").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.min(F.struct("line_no", F.left("line", F.lit(most)).alias("t"))).alias("s")).select("file", "n", "first_line", F.col("s.t").alias("text"))


def directory_bucket(path: Column) -> Column:
    """``dir/`` of a path, ``./`` for a path of one part."""
    p = F.regexp_replace(F.regexp_replace(T.trim(path), r"^\./", ""), "/{2,}", "/")
    d = F.regexp_replace(p, "/?[^/]*$", "")
    return F.when((d == "") & p.startswith("/"), "/").when(d == "", "./").otherwise(F.concat(d, F.lit("/")))


def top_bucket(path: Column) -> Column:
    """``first/`` of a path, ``.`` for a path of one part."""
    p = F.regexp_replace(T.trim(path), r"^\./", "")
    return F.when(~p.contains("/"), ".").otherwise(F.concat(F.substring_index(p, "/", 1), F.lit("/")))


def extension_bucket(path: Column) -> Column:
    """The last ``.ext`` of a file's name in lower case, else ``[no-ext]``."""
    x = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1))
    return F.when(x == "", "[no-ext]").otherwise(x)


def inventory(paths: DataFrame, path: str) -> DataFrame:
    """``kind, value, n``: distinct paths by folder, top folder and extension."""
    p = paths.select(F.col(path).alias("p")).where("p is not null").distinct()
    c = F.col("p")
    kinds = (("dir", directory_bucket(c)), ("top", top_bucket(c)), ("ext", extension_bucket(c)))
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds]))
    return p.select(e.alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def diff_stats(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, files, hunks, added, removed`` of the diffs in each text, without moving its lines."""
    ls = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    n = lambda p: F.size(F.filter(ls, lambda x: x.rlike(p)))
    return df.select(F.col(record_id).alias("record_id"), n("^diff --git ").alias("files"), n("^@@ ").alias("hunks"), n(r"^\+(?!\+\+)").alias("added"), n("^-(?!--)").alias("removed"))


def file_diffs(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, file, hunks, added, removed``: a unified diff by file; lines before the first file belong to none."""
    parts = F.split(F.col(text), r"(?m)^diff --git ")
    e = df.select(F.col(record_id).alias("record_id"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("part"))
    ls = F.split("part", "\n")
    n = lambda p: F.size(F.filter(ls, lambda x: x.rlike(p)))
    return e.select("record_id", F.regexp_extract("part", r"^a/\S+ b/(\S+)", 1).alias("file"), n("^@@ ").alias("hunks"), n(r"^\+(?!\+\+)").alias("added"), n("^-(?!--)").alias("removed"))


def tree(paths: DataFrame, path: str) -> DataFrame:
    """``dir, depth, label``: the folders and files above and at the paths, as lines of an indented tree.

    A folder whose only child has children is one line with it (``a/b/c/``); lines sorted by ``dir`` are in the tree's order.
    Empty and ``.`` parts don't count. The root has the empty ``dir``.
    """
    p = paths.select(F.filter(F.split(F.col(path), "/"), lambda x: ~x.isin("", ".")).alias("s")).where("size(s) > 0").distinct()
    up = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(F.slice("s", 1, i - 1).alias("dir"), F.slice("s", 1, i).alias("node")))
    e = p.select(F.explode(up).alias("e")).select("e.*").distinct()
    kids = e.groupBy(F.col("dir").alias("node")).agg(F.count("*").alias("kids"))
    n = e.join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    # a node is drawn into its parent's line if it is the only child, has children itself, and the parent isn't the root
    merged = n.join(kids.select(F.col("node").alias("dir"), F.col("kids").alias("siblings")), "dir").withColumn("merged", (F.col("siblings") == 1) & (F.col("kids") > 0) & (F.size("dir") > 0))
    heads = merged.where("not merged").select("node", "kids")
    # each node's chain ends where the merged ones below it end
    inner = merged.where("merged").select("node", "kids")
    ups = F.transform(F.sequence(F.lit(1), F.size("node")), lambda i: F.slice("node", 1, i))
    starts = heads.select(F.col("node").alias("above"), F.lit(True).alias("is_head"))
    chain = inner.select("node", F.posexplode(ups).alias("p", "above")).join(starts, "above").groupBy("node").agg(F.max_by("above", "p").alias("head"))
    tail = chain.groupBy(F.col("head").alias("node")).agg(F.max_by("node", F.size("node")).alias("end"))
    # the depth of a line is the number of heads above it
    depth = heads.select("node", F.explode(ups).alias("above")).join(starts, "above").groupBy("node").agg(F.count("*").alias("depth"))
    out = heads.join(tail, "node", "left").join(depth, "node")
    own = F.element_at("node", -1)
    more = F.array_join(F.slice("end", F.size("node") + 1, F.greatest(F.size("end") - F.size("node"), F.lit(0))), "/")
    label = F.when(F.col("end").isNotNull(), F.concat(own, F.lit("/"), more, F.lit("/"))).otherwise(own)
    return out.select(F.array_join("node", "/").alias("dir"), F.col("depth").cast("int").alias("depth"), F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), label).alias("label"))


def rendered_tree(lines: DataFrame, root: str = ".", most: int = 100) -> DataFrame:
    """``line_no, line``: the first lines of a tree below its root, and how many more there are."""
    body = lines.orderBy("dir").limit(most - 1).withColumn("line_no", F.row_number().over(Window.orderBy("dir")) + 1).select("line_no", F.col("label").alias("line"))
    first = lines.sparkSession.createDataFrame([(1, root)], "line_no int, line string")
    more = lines.agg(F.count("*").alias("n")).where(F.col("n") > most - 1).select(F.lit(most + 1).alias("line_no"), F.format_string("... +%d more", F.col("n") - (most - 1)).alias("line"))
    return first.unionByName(body).unionByName(more)
