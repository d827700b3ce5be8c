"""The files between the stages, as tab-separated text: a Spark reader and a writer for each, and the line forms they use.

Files may be gzipped. Every table has its line as a column function, so that a stream or a test can use it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmap.constants import MOTIF_CLASSES
from stallmap.functions.intervals import as_text, from_text, pieces_as_text, pieces_from_text

#: Signal lines with fewer fields than these are no signal lines; those with just these have no first alpha, and aren't rows.
SIGNAL_FIELDS = 8


#: Folders that a writer adds and its reader takes away again; callers' own columns can't be called so.
_FOLDERS = ("contig_", "strand_")


def _write(lines: DataFrame, path: str, gz: bool = True, by: tuple[str, ...] = ()) -> None:
    lines.write.partitionBy(*by).option("compression", "gzip" if gz else "none").text(path)


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows in order over all partitions: dealt by ranges of all of `order`, whose bounds Spark samples, so a contig with many rows is many
    partitions, and sorted within each. Spark names files by partition, so the files of a folder, by name, are in order, too."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _own(by: tuple[str, ...]) -> tuple[str, ...]:
    if clash := {c.lower() for c in by} & {*_FOLDERS, "line", "value"}:
        raise ValueError(f"columns can't be called {', '.join(sorted(clash))} here")
    return by


def manifest(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The data files of a stored table, (path below its folder, bytes), in the order of their rows: folder by folder, and in
    each by name. Joined in this order, the files of one folder are one sorted file (zipped ones, too)."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    root, out = fs.makeQualified(top).toString().rstrip("/"), []
    files = fs.listFiles(top, True)
    while files.hasNext():
        x = files.next()
        name = x.getPath().toString().removeprefix(root).lstrip("/")
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            out.append((name, x.getLen()))
    return sorted(out, key=lambda x: (x[0].rpartition("/")[0], x[0]))


def _tab(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).alias("line")


def _fields(line: str = "value") -> tuple[Column, callable]:
    f = F.split(line, "\t")
    return f, lambda i, kind="string": F.get(f, F.lit(i)).cast(kind)


# ---- blocks, weights ----


def block_line() -> Column:
    """contig:start-end:strand:ord"""
    return F.concat(as_text(F.col("contig"), F.col("start"), F.col("end"), F.col("strand")), F.lit(":"), F.col("ord").cast("string")).alias("line")


def blocks_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """contig, start, end, strand, ord."""
    return lines.select(from_text(F.col(line)).alias("p")).select("p.*")


def write_blocks(blocks: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A folder for each of `by` (sample columns) and contig; in each, over its files, by start and end."""
    rows = in_ranges(blocks, *_own(by), "contig", "start", "end")
    _write(rows.select(*by, F.col("contig").alias("contig_"), block_line()), path, by=(*by, "contig_"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path)
    named = [c for c in rows.columns if c not in ("value", "contig_")]
    return rows.select(*named, from_text(F.col("value")).alias("p")).select(*named, "p.*")


def write_weights(weights: DataFrame, path: str) -> None:
    """read_id, weight."""
    _write(weights.select(_tab("read_id", "weight")), path)


def weights_of(lines: DataFrame, line: str = "value") -> DataFrame:
    _, at = _fields(line)
    return lines.select(at(0, "long").alias("read_id"), at(1, "int").alias("weight"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return weights_of(spark.read.text(path))


# ---- pile-up ----


def pileup_line() -> Column:
    return _tab("contig", "pos", F.col("pos") + 1, "cov", "rss", "strand")


def pileup_of(lines: DataFrame, line: str = "value", *more: str) -> DataFrame:
    """contig, pos, cov, rss, strand. A row that isn't one base wide is an error."""
    f, at = _fields(line)
    wide = F.raise_error(F.concat(F.lit("not one base: "), F.col(line))).cast("int")
    pos = F.when(at(2, "int") - at(1, "int") == 1, at(1, "int")).otherwise(wide)
    return lines.select(*more, at(0).alias("contig"), pos.alias("pos"), at(3, "long").alias("cov"), at(4, "long").alias("rss"), at(5).alias("strand"))


def write_pileup(piled: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A folder for each of `by` and strand; in each, over its files, by contig and position."""
    rows = in_ranges(piled, *_own(by), "strand", "contig", "pos")
    _write(rows.select(*by, F.col("strand").alias("strand_"), pileup_line()), path, by=(*by, "strand_"))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path)
    return pileup_of(rows, "value", *[c for c in rows.columns if c not in ("value", "strand_")])


# ---- signal ----


def signal_line() -> Column:
    """Its last fields are the first alpha and as many second alphas as there are."""
    alphas = F.concat(F.array("first_alpha"), F.coalesce("second_alpha", F.array().cast("array<double>")))
    return _tab("contig", "pos", F.col("pos") + 1, "strand", "cov_t", "rss_t", "cov_c", "rss_c", F.array_join(alphas.cast("array<string>"), "\t"))


def signal_of(lines: DataFrame, line: str = "value", swapped: bool = False, *more: str) -> DataFrame:
    """contig, strand, pos, cov_t, rss_t, cov_c, rss_c, first_alpha, second_alpha (null if there are none). Lines of fewer than
    SIGNAL_FIELDS fields are an error; those of just so many are left out. swapped: treatment and control exchanged."""
    f, at = _fields(line)
    n = F.size(f)
    short = F.raise_error(F.concat(F.lit("too few fields: "), F.col(line))).cast("boolean")
    rows = lines.where(F.when(n < SIGNAL_FIELDS, short).otherwise(n > SIGNAL_FIELDS))
    counts = ("cov_c", "rss_c", "cov_t", "rss_t") if swapped else ("cov_t", "rss_t", "cov_c", "rss_c")
    own = dict(zip(counts, (at(i, "long") for i in range(4, 8))))
    second = F.when(n > SIGNAL_FIELDS + 1, F.slice(f, SIGNAL_FIELDS + 2, 7).cast("array<double>"))
    return rows.select(*more, at(0).alias("contig"), at(3).alias("strand"), at(1, "int").alias("pos"), *[own[c].alias(c) for c in ("cov_t", "rss_t", "cov_c", "rss_c")], at(8, "double").alias("first_alpha"), second.alias("second_alpha"))


def write_signal(signal: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A folder for each of `by` and strand; in each, over its files, by contig and position."""
    rows = in_ranges(signal, *_own(by), "strand", "contig", "pos")
    _write(rows.select(*by, F.col("strand").alias("strand_"), signal_line()), path, by=(*by, "strand_"))


def read_signal(spark: SparkSession, path: str, swapped: bool = False) -> DataFrame:
    rows = spark.read.text(path)
    return signal_of(rows, "value", swapped, *[c for c in rows.columns if c not in ("value", "strand_")])


# ---- whitelist, motifs ----


def bed_line() -> Column:
    return _tab("contig", "start", "end", F.lit("."), F.lit("0"), "strand")


def write_bed(runs: DataFrame, path: str) -> None:
    """Over all files by contig, strand and start."""
    _write(in_ranges(runs, "contig", "strand", "start").select(bed_line()), path)


def motif_line() -> Column:
    """Twelve fields: contig, start, end, name, strand, class, sequence, pieces, flank|motif|flank, transcripts (id|regions;...),
    pieces of the flank before and of the one after."""
    text = lambda c: pieces_as_text(F.col("contig"), F.col(c), F.col("strand"))
    who = F.array_join(F.transform("transcripts", lambda t: F.concat(t["id"], F.lit("|"), F.array_join(t["regions"], ","))), ";")
    return _tab("contig", "start", "end", "name", "strand", "class", "sequence", text("pieces"), "flank_sequence", who, text("left"), text("right"))


def motifs_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """The columns of motif.rows(). Fields that are missing at the end are empty."""
    f, at = _fields(line)
    priority = F.coalesce(*[F.when(at(5) == name, F.lit(c)) for c, name in MOTIF_CLASSES.items()])
    who = F.transform(F.filter(F.split(at(9), ";"), lambda x: x != ""), lambda x: F.struct(F.split(x, r"\|")[0].alias("id"), F.filter(F.split(F.get(F.split(x, r"\|"), F.lit(1)), ","), lambda r: r != "").alias("regions")))
    list_ = lambda i: pieces_from_text(F.coalesce(at(i), F.lit("")))
    return lines.select(
        at(0).alias("contig"), at(1, "int").alias("start"), at(2, "int").alias("end"), at(3).alias("name"), at(4).alias("strand"), at(5).alias("class"), at(6).alias("sequence"),
        list_(7).alias("pieces"), at(8).alias("flank_sequence"), who.alias("transcripts"), list_(10).alias("left"), list_(11).alias("right"), priority.alias("priority"),
    )


def write_motifs(motifs: DataFrame, path: str) -> None:
    """Over all files by all fields, contig and strand first."""
    order = ["contig", "strand", "start", "end", "name", "class", "sequence", "flank_sequence", "line"]
    _write(in_ranges(motifs.withColumn("line", motif_line()), *order).select("line"), path)


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    return motifs_of(spark.read.text(path))


# ---- groups of clusters ----


def cluster_line() -> Column:
    """Seven fields: contig, start, end, gene_name|gene_id, group, strand, clusters (transcript|regions|pieces;...)."""
    strand = F.col("strand")
    who = lambda m: F.concat_ws("|", m["id"], F.array_join(m["regions"], ","), pieces_as_text(F.col("contig"), m["pieces"], strand))
    return _tab("contig", "start", "end", F.concat_ws("|", "gene_name", "gene_id"), "group", "strand", F.array_join(F.transform("members", who), ";"))


def write_clusters(groups: DataFrame, path: str) -> None:
    """Over all files by contig, strand and start."""
    order = ["contig", "strand", "start", "end", "gene_id", "group"]
    _write(in_ranges(groups, *order).select(cluster_line()), path)


def clusters_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """contig, start, end, name, group, strand, members (id, regions, pieces)."""
    _, at = _fields(line)

    def member(x: Column) -> Column:
        f = F.split(x, r"\|")
        regions = F.filter(F.split(F.get(f, F.lit(1)), ","), lambda r: r != "")
        return F.struct(F.get(f, F.lit(0)).alias("id"), regions.alias("regions"), pieces_from_text(F.get(f, F.lit(2))).alias("pieces"))

    members = F.transform(F.filter(F.split(at(6), ";"), lambda x: x != ""), member)
    return lines.select(at(0).alias("contig"), at(1, "int").alias("start"), at(2, "int").alias("end"), at(3).alias("name"), at(4, "int").alias("group"), at(5).alias("strand"), members.alias("members"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return clusters_of(spark.read.text(path))


# ---- cutoff ----


def cutoff_lines(chosen: DataFrame) -> DataFrame:
    """One row (first_alpha, second_alpha) as two lines, the first alpha first."""
    return chosen.select(F.posexplode(F.array("first_alpha", "second_alpha")).alias("nth", "a")).orderBy("nth").select(F.col("a").cast("string").alias("line"))


def write_cutoff(chosen: DataFrame, path: str) -> None:
    _write(cutoff_lines(chosen).coalesce(1), path, gz=False)


def write_curve(points: DataFrame, path: str) -> None:
    """The points of cutoff.curve(), a folder for each sample: first alpha's number, alpha, positives, negatives, rate; in order."""
    rows = in_ranges(points, "cond", "rep", "k", "alpha")
    _write(rows.select("cond", "rep", _tab("k", "alpha", "n_pos", "n_neg", "fdr")), path, gz=False, by=("cond", "rep"))


def cutoff_of(texts: DataFrame, *more: str) -> DataFrame:
    """texts (value: a whole file) -> first_alpha, second_alpha."""
    a = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return texts.where("trim(value) != ''").select(*more, a[0].cast("double").alias("first_alpha"), a[1].cast("double").alias("second_alpha"))


def read_cutoff(spark: SparkSession, path: str) -> DataFrame:
    return cutoff_of(spark.read.text(path, wholetext=True))
