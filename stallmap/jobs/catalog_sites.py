"""The registered queries on sequence, annotation, motifs and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmap.constants import MOTIF_CLASSES, MOTIF_KINDS, WINDOW, motif_pattern
from stallmap.functions import genome, intervals, sequence
from stallmap.functions.joins import dealt
from stallmap.jobs import lens, pipeline
from stallmap.jobs.catalog import _SIGNAL, _hits, _signal, query, tiled, white
from stallmap.operators import annotation, motif, report, signal, sites
from stallmap.operators.sites import SITE
from stallmap.sources import tables
from stallmap.sources.text import bed_of
from stallmap.storage import materialize

# ---- sequence ----

_RC = "reverse(translate({0}, 'ACGTNacgtn', 'TGCANtgcan'))"


@query(f"WITH {lens.GENOME} SELECT contig, length(seq) AS n, md5({_RC.format('seq')}) AS rc FROM genome")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other strand of every contig."""
    return lens.genome(spark, sf_dir).select("contig", F.length("seq").cast("long").alias("n"), F.md5(sequence.reverse_complement(F.col("seq"))).alias("rc"))


_WINDOWS = lens.GENOME + """, windows AS (
    SELECT contig, pos, substr(seq, pos - 9, 10) AS w FROM (SELECT contig, seq, unnest(range(10, length(seq))) AS pos FROM genome)
), white AS (
    SELECT contig, pos FROM windows WHERE contains(right(w, 3), 'G') AND (contains(w, 'GG') OR length(w) - length(replace(w, 'G', '')) >= 3)
)"""


def _white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return white(tiled(spark, sf_dir))


def _white_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.whitelisted_runs(tiled(spark, sf_dir), WINDOW)


@query(f"WITH {_WINDOWS} SELECT contig, count(*) AS n, min(pos) AS first, max(pos) AS last, CAST(sum(pos) AS BIGINT) AS total FROM white GROUP BY contig")
def seq_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, W5."""
    w = _white(spark, sf_dir).groupBy("contig").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("pos").alias("total"))
    return w.select("contig", "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "total")


@query(f"WITH {_WINDOWS}, r AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM white) SELECT contig, min(pos) AS start, max(pos) + 1 AS \"end\" FROM r GROUP BY contig, g")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, D12."""
    runs = _white_runs(spark, sf_dir)
    return runs.select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    f"""WITH {_SIGNAL}, {_WINDOWS} SELECT h.contig, h.strand, h.cond, h.rep, h.pos FROM hits h WHERE EXISTS (SELECT 1 FROM white w WHERE w.contig = h.contig AND w.pos = h.pos)"""
)
def whitelist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, J4."""
    runs = _white_runs(spark, sf_dir)
    return intervals.points_within(_hits(spark, sf_dir), runs, 64, ["contig"]).select("contig", "strand", "cond", "rep", "pos")


@query(
    f"""WITH {_SIGNAL}, {lens.GENOME} SELECT h.contig, h.strand, h.cond, h.rep, h.pos,
    CASE WHEN h.strand = '+' THEN substr(seq, h.pos + 1, 1) ELSE {_RC.format('substr(seq, h.pos + 2, 1)')} END = 'G' AS g_next FROM hits h JOIN genome g ON h.contig = g.contig"""
)
def g_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    rows = signal.next_base(_hits(spark, sf_dir), tiled(spark, sf_dir))
    return rows.select("contig", "strand", "cond", "rep", "pos", (F.col("base3") == "G").alias("g_next"))


# The bases before each called stop: P8 to P10 judge those.
_UPSTREAM = f"""{_SIGNAL}, {lens.GENOME}, x AS (
    SELECT h.contig, h.strand, h.cond, h.rep, h.pos, CASE WHEN h.strand = '+' THEN substr(seq, greatest(h.pos - 59, 0) + 1, h.pos + 1 - greatest(h.pos - 59, 0)) ELSE {_RC.format('substr(seq, h.pos + 1, 60)')} END AS w
    FROM hits h JOIN genome g ON h.contig = g.contig
)"""
_HIT_KEY = "contig, strand, cond, rep, pos"
_PERCENT = f"""e AS (SELECT {_HIT_KEY}, w, unnest(range(0, 40)) AS i FROM x), p AS (
    SELECT {_HIT_KEY}, max(100.0::DOUBLE * (length(substr(w, i + 1)) - length(replace(substr(w, i + 1), 'G', ''))) / (50 - i)) AS g FROM e GROUP BY {_HIT_KEY}
)"""
_RUNS = f"""runs AS (
    SELECT {_HIT_KEY}, w, list_sum(list_transform(regexp_extract_all(w, 'G{{2,}}'), lambda r: CASE WHEN length(r) >= 6 THEN 2 ELSE 1 END)) AS n, length(regexp_replace(w, '^.*GG', '')) AS tail FROM x
), counted AS (
    SELECT {_HIT_KEY}, w, CASE WHEN tail <= 2 AND n >= 3 THEN CAST(least(n, 4) AS INT) END AS g_runs FROM runs
)"""


def _upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.upstream(_hits(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in ("start", "end")}), tiled(spark, sf_dir))
    return rows.join(lens.genome(spark, sf_dir).select("contig"), "contig", "left_semi")


@query(f"WITH {_UPSTREAM}, {_PERCENT} SELECT {_HIT_KEY}, round(g, 6) AS g_percent FROM p")
def g_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, before every called stop."""
    return _upstream(spark, sf_dir).select("contig", "strand", "cond", "rep", "pos", F.round(sequence.g_percent(F.col("window")), 6).alias("g_percent"))


@query(f"WITH {_UPSTREAM}, {_RUNS} SELECT {_HIT_KEY}, g_runs FROM counted")
def g_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, before every called stop."""
    return _upstream(spark, sf_dir).select("contig", "strand", "cond", "rep", "pos", sequence.g_runs(F.col("window")).alias("g_runs"))


@query(
    f"""WITH {_UPSTREAM}, {_RUNS}, {_PERCENT}
    SELECT c.contig, c.strand, c.cond, c.rep, c.pos, CASE WHEN g >= 40 THEN CASE WHEN g_runs >= 4 THEN 'potential G-quadruplex & G>=40%' WHEN g_runs = 3 THEN 'potential G-triplex & G>=40%' ELSE 'G>=40%' END ELSE 'Unknown' END AS verdict
    FROM counted c JOIN p ON c.contig = p.contig AND c.strand = p.strand AND c.cond = p.cond AND c.rep = p.rep AND c.pos = p.pos"""
)
def novel_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, before every called stop."""
    return _upstream(spark, sf_dir).select("contig", "strand", "cond", "rep", "pos", sequence.novel_verdict(F.col("window")).alias("verdict"))


@query(f"WITH {_WINDOWS}, r AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM white) SELECT contig, '+' AS strand, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS \"end\" FROM r GROUP BY contig, g")
def parse_bed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted runs as lines of text and back."""
    runs = _white_runs(spark, sf_dir).withColumn("strand", F.lit("+"))
    return bed_of(runs.select(tables.bed_line().alias("value")))


# ---- annotation ----


@query(f"WITH {lens.GENES} SELECT e.transcript_id, e.e, g.gene_id, g.gene_name FROM exons e JOIN transcripts t ON e.transcript_id = t.transcript_id JOIN genes g ON t.gene_id = g.gene_id")
def hierarchy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, D6."""
    rows = annotation.hierarchy(lens.genes(spark, sf_dir), lens.transcripts(spark, sf_dir), lens.exons(spark, sf_dir).drop("gene_id"))
    return rows.select("transcript_id", "e", "gene_id", "gene_name")


@query(f"WITH {lens.GENES} SELECT transcript_id, e FROM exons x WHERE NOT EXISTS (SELECT 1 FROM cds c WHERE c.transcript_id = x.transcript_id)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of transcripts without coding sequence."""
    return annotation.orphans(lens.exons(spark, sf_dir), lens.cds(spark, sf_dir).select("transcript_id").distinct(), "transcript_id").select("transcript_id", "e")


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.numbered(lens.exons(spark, sf_dir).drop("e"))


@query(f"WITH {lens.GENES} SELECT transcript_id, st AS start, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -st ELSE st END) AS INT) AS number FROM exons")
def exon_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return _exons(spark, sf_dir).select("transcript_id", "start", "number")


@query(
    f"""WITH {lens.GENES}, o AS (SELECT *, lead(st) OVER w AS ns, lead(en) OVER w AS ne, row_number() OVER w AS number FROM exons WINDOW w AS (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -st ELSE st END))
    SELECT transcript_id, CAST(number AS INT) AS number, CASE WHEN strand = '-' THEN ne ELSE en END AS intron_start, CASE WHEN strand = '-' THEN st ELSE ns END AS intron_end FROM o WHERE ns IS NOT NULL"""
)
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return annotation.junctions(_exons(spark, sf_dir)).select("transcript_id", "number", "intron_start", "intron_end")


_SPLICED = f"""{lens.GENES}, {lens.GENOME}, cut AS (
    SELECT e.transcript_id, e.e, CASE WHEN e.strand = '-' THEN {_RC.format('substr(g.seq, e.st + 1, e.en - e.st)')} ELSE substr(g.seq, e.st + 1, e.en - e.st) END AS s FROM exons e JOIN genome g ON e.contig = g.contig AND g.seq <> ''
), spliced AS (
    SELECT transcript_id, string_agg(s, '' ORDER BY e) AS seq FROM cut GROUP BY transcript_id
)"""


def _spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(annotation.transcript_sequences(_exons(spark, sf_dir), tiled(spark, sf_dir)), "spliced")


@query(f"WITH {_SPLICED} SELECT transcript_id, seq FROM spliced")
def transcript_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    return annotation.transcript_sequences(_exons(spark, sf_dir), tiled(spark, sf_dir))


# The rule: in a junction's text of up to ten bases of either side, each base with ten before it, the first of the next exon included.
@query(
    f"""WITH {_SPLICED}, spots AS (SELECT s.transcript_id, s.seq, unnest(list_concat(range(80, 90), range(160, 170))) AS stop FROM spliced s)
    SELECT x.transcript_id, CAST(x.stop AS INT) AS stop, CAST(CASE WHEN e.strand = '-' THEN e.en - 1 - (x.stop - 80 * (e.e - 1)) ELSE e.st + (x.stop - 80 * (e.e - 1)) END AS INT) AS pos, substr(x.seq, x.stop - 9, 10) AS "window"
    FROM spots x JOIN exons e ON e.transcript_id = x.transcript_id AND e.e = x.stop // 80 + 1 WHERE x.stop < length(x.seq)"""
)
def junction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, with the places on the genome."""
    return annotation.junction_windows(_exons(spark, sf_dir), _spliced(spark, sf_dir)).select("transcript_id", "stop", "pos", "window")


@query(
    f"""WITH {lens.GENES}, {lens.GENOME} SELECT contig, CAST(row_number() OVER (ORDER BY first, contig) AS INT) AS place FROM (
        SELECT contig, min(key) AS first FROM genes WHERE contig IN (SELECT contig FROM genome WHERE seq <> '') GROUP BY contig)"""
)
def contig_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs in the order of the annotation, of those that the genome has."""
    return annotation.contig_order(lens.genes(spark, sf_dir).select("contig", F.col("key").alias("nth")), tiled(spark, sf_dir))


_UTR = f"""{lens.GENES}, coding AS (SELECT transcript_id, min(st) AS c0, max(en) AS c1 FROM cds GROUP BY 1), utr AS (
    SELECT e.transcript_id, e.contig, e.strand, CASE WHEN e.strand <> '-' THEN '5UTR' ELSE '3UTR' END AS region, e.st, least(e.en, c0) AS en FROM exons e JOIN coding c ON e.transcript_id = c.transcript_id WHERE e.st < least(e.en, c0)
    UNION ALL
    SELECT e.transcript_id, e.contig, e.strand, CASE WHEN e.strand <> '-' THEN '3UTR' ELSE '5UTR' END, greatest(e.st, c1), e.en FROM exons e JOIN coding c ON e.transcript_id = c.transcript_id WHERE greatest(e.st, c1) < e.en
)"""


@query(f"WITH {_UTR} SELECT transcript_id, contig, strand, region, st AS start, en AS \"end\" FROM utr")
def utr_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    return annotation.untranslated(lens.exons(spark, sf_dir), lens.cds(spark, sf_dir))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    coding = lens.cds(spark, sf_dir).withColumn("region", F.lit("CDS"))
    return annotation.untranslated(lens.exons(spark, sf_dir), lens.cds(spark, sf_dir)).unionByName(coding)


@query(f"WITH {lens.GENES}, s AS (SELECT contig, strand, st, en, row_number() OVER (PARTITION BY contig, strand ORDER BY st, en) AS n, max(en) OVER (PARTITION BY contig, strand ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM exons), m AS (SELECT *, sum(CASE WHEN st > far THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY n) AS g FROM s) SELECT contig, strand, min(st) AS start, max(en) AS \"end\" FROM m GROUP BY contig, strand, g")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of all genes."""
    return intervals.union(lens.exons(spark, sf_dir))


@query(
    f"""WITH {lens.GENES}, p AS (SELECT transcript_id, strand, unnest(range(st, en)) AS pos FROM exons), r AS (SELECT *, pos - row_number() OVER (PARTITION BY transcript_id ORDER BY pos) AS g FROM p),
    i AS (SELECT transcript_id, any_value(strand) AS strand, min(pos) AS s, max(pos) + 1 AS e FROM r GROUP BY transcript_id, g)
    SELECT transcript_id, string_agg(concat(CAST(s AS VARCHAR), '-', CAST(e AS VARCHAR)), ',' ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END) AS pieces, CAST(min(s) AS INT) AS first, CAST(max(e) AS INT) AS last FROM i GROUP BY transcript_id"""
)
def positions_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript's positions as intervals 5' to 3', and their bounds."""
    own = F.collect_list(F.sequence("start", F.col("end") - 1))
    # Positions are arrays of their transcript, no rows.
    p = lens.exons(spark, sf_dir).groupBy("transcript_id", "strand").agg(F.flatten(own).alias("p"))
    out = p.select("transcript_id", "strand", F.explode(F.array(intervals.runs_in(F.col("p")))).alias("up"))
    out = out.withColumns({"first": F.element_at("up", 1)["start"], "last": F.element_at("up", -1)["end"]})
    ordered = F.when(F.col("strand") == "-", F.reverse("up")).otherwise(F.col("up"))
    return out.select("transcript_id", F.array_join(F.transform(ordered, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("pieces"), "first", "last")


@query("SELECT gene_name, CASE WHEN list_contains(t, 'protein_coding') THEN 'protein_coding' WHEN list_contains(t, 'mRNA') THEN 'mRNA' ELSE array_to_string(t, ',') END AS kind FROM (SELECT p_brand AS gene_name, list_sort(list_distinct(list(CASE p_size % 5 WHEN 0 THEN CASE WHEN p_partkey % 11 = 0 THEN 'protein_coding' ELSE 'ncRNA' END WHEN 1 THEN CASE WHEN p_partkey % 7 = 0 THEN 'mRNA' ELSE 'snRNA' END ELSE 'lnc_RNA' END))) AS t FROM part GROUP BY p_brand)")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    kind = F.expr("CASE p_size % 5 WHEN 0 THEN CASE WHEN p_partkey % 11 = 0 THEN 'protein_coding' ELSE 'ncRNA' END WHEN 1 THEN CASE WHEN p_partkey % 7 = 0 THEN 'mRNA' ELSE 'snRNA' END ELSE 'lnc_RNA' END")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", kind.alias("t")).groupBy("p_brand").agg(F.collect_set("t").alias("t"))
    return rows.select(F.col("p_brand").alias("gene_name"), annotation.inferred_type(F.col("t")).alias("kind"))


@query("WITH i AS (SELECT o_custkey, concat(['NM', 'NR', 'XM', 'XR', 'ZZ'][CAST(o_orderkey % 5 AS INT) + 1], '_', CAST(o_orderkey AS VARCHAR)) AS id, CAST(o_orderkey % 5 AS INT) AS r FROM orders), b AS (SELECT o_custkey, min(r) AS r FROM i WHERE r < 4 GROUP BY 1) SELECT i.o_custkey, string_agg(i.id, ',' ORDER BY i.id) AS ids FROM i JOIN b ON i.o_custkey = b.o_custkey AND i.r = b.r GROUP BY 1")
def id_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    id_ = F.expr("concat(element_at(array('NM', 'NR', 'XM', 'XR', 'ZZ'), CAST(o_orderkey % 5 AS INT) + 1), '_', CAST(o_orderkey AS STRING))")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.collect_set(id_).alias("ids"))
    kept = annotation.by_priority(F.col("ids"))
    return rows.where(F.size(kept) > 0).select("o_custkey", F.array_join(F.array_sort(kept), ",").alias("ids"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('id', CAST(p_partkey AS VARCHAR)) WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS name FROM part")
def coalesce_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an attribute's names that a row has."""
    attrs = F.expr("str_to_map(CASE p_partkey % 3 WHEN 0 THEN concat('gene_name=id', CAST(p_partkey AS STRING), ';Name=', p_name) WHEN 1 THEN concat('x=1;Name=', p_name) ELSE 'x=1' END, ';', '=')")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", attrs.alias("a"))
    return rows.select("p_partkey", F.coalesce(annotation.first_of(F.col("a"), "gene_name", "gene", "Name", "description"), F.lit("")).alias("name"))


# ---- sites ----

_ISLANDS = f"""{_SIGNAL}, idd AS (
    SELECT contig, strand, st, en, CASE WHEN cond = 'KPDS' THEN rep * 10 ELSE rep END AS id FROM hits
), far AS (
    SELECT *, max(en) OVER (PARTITION BY contig, strand ORDER BY st, en, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM idd
), grouped AS (
    SELECT *, sum(CASE WHEN st > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY st, en, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM far
), islands AS (
    SELECT contig, strand, min(st) AS st, max(en) AS en, list_sort(list_distinct(list(id))) AS ids FROM grouped GROUP BY contig, strand, g
), sites AS (
    SELECT * FROM islands WHERE len(list_intersect(ids, [1, 2, 3, 4])) >= 1 AND len(list_intersect(ids, [10, 20, 30, 40])) >= 1 AND len(ids) >= 3
)"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_islands(_hits(spark, sf_dir))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir).where(sites.is_supported(F.col("ids")))


@query(f"WITH {_ISLANDS} SELECT contig, strand, st AS start, en AS \"end\", array_to_string(ids, ',') AS ids FROM islands")
def site_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, A7."""
    return _islands(spark, sf_dir).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(
    f"""WITH {_SIGNAL}, k AS (SELECT * FROM hits WHERE cond = 'K'), far AS (SELECT *, max(en) OVER (PARTITION BY contig, strand ORDER BY st, en, rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k),
    grouped AS (SELECT *, sum(CASE WHEN st > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY st, en, rep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM far)
    SELECT contig, strand, min(st) AS start, max(en) AS "end", count(DISTINCT rep) AS n_reps FROM grouped GROUP BY contig, strand, g"""
)
def site_islands_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    found = sites.site_islands(_hits(spark, sf_dir).where("cond = 'K'"))
    return found.select("contig", "strand", "start", "end", F.size("ids").cast("long").alias("n_reps"))


@query(f"WITH {_ISLANDS} SELECT contig, strand, st AS start, en AS \"end\" FROM sites")
def rts_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice from reads to supported sites: F15 on W1."""
    return _sites(spark, sf_dir).select("contig", "strand", "start", "end")


@query(f"WITH {_ISLANDS} SELECT strand, len(ids) AS n_reps, count(*) AS n, CAST(sum(CASE WHEN len(ids) >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_two FROM islands GROUP BY ALL")
def replicate_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, one condition's rule."""
    rows = _islands(spark, sf_dir).groupBy("strand", F.size("ids").cast("long").alias("n_reps"))
    return rows.agg(F.count("*").alias("n"), F.sum(sites.is_supported(F.col("ids"), False).cast("long")).alias("n_two"))


@query(f"WITH {_ISLANDS} SELECT contig, strand, st AS start, en AS \"end\", len(list_intersect(ids, [1, 2, 3, 4])) AS n_k, len(list_distinct(list_concat(ids, [1, 10]))) AS n_union FROM islands")
def array_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and intersection of replicate sets."""
    ids = F.col("ids")
    four, two = F.array(*[F.lit(k) for k in (1, 2, 3, 4)]), F.array(F.lit(1), F.lit(10))
    return _islands(spark, sf_dir).select(*SITE, F.size(F.array_intersect(ids, four)).cast("long").alias("n_k"), F.size(F.array_union(ids, two)).cast("long").alias("n_union"))


@query(
    f"""WITH {_ISLANDS}, meet AS (SELECT s.contig, s.strand, s.st, s.en, h.cov_t, least(s.en, h.en) - greatest(s.st, h.st) AS n FROM sites s JOIN hits h ON s.contig = h.contig AND s.strand = h.strand AND s.st < h.en AND h.st < s.en)
    SELECT contig, strand, st AS start, en AS "end", CAST(round_even(sum(cov_t * n) / sum(n), 0) AS BIGINT) AS coverage FROM meet GROUP BY ALL"""
)
def site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A8."""
    return sites.site_coverage(_sites(spark, sf_dir), _hits(spark, sf_dir))


@query(f"WITH {_ISLANDS}, {lens.GENES} SELECT s.contig, s.strand, s.st AS start, s.en AS \"end\", t.transcript_id FROM islands s JOIN transcripts t ON s.contig = t.contig AND s.strand = t.strand AND s.st < t.en AND t.st < s.en")
def annotation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, P11."""
    return annotation.overlapping_transcripts(_islands(spark, sf_dir).select(*SITE), lens.transcripts(spark, sf_dir)).select(*SITE, "transcript_id")


_HIT = f"""{_ISLANDS}, {_UTR}, regions AS (SELECT transcript_id, region, st, en FROM utr UNION ALL SELECT transcript_id, 'CDS', st, en FROM cds), hit AS (
    SELECT s.contig, s.strand, s.st, s.en, t.transcript_id, t.gene_name, r.region FROM islands s JOIN transcripts t ON s.contig = t.contig AND s.strand = t.strand AND s.st < t.en AND t.st < s.en
    LEFT JOIN regions r ON r.transcript_id = t.transcript_id AND s.st < r.en AND r.st < s.en
)"""


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.with_regions(lens.transcripts(spark, sf_dir), _regions(spark, sf_dir))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each island, in one piece, with the transcripts that it overlaps."""
    places = _islands(spark, sf_dir).select(*SITE, F.array(F.struct("start", "end")).cast(intervals.PIECES).alias("pieces"))
    return annotation.annotated(places, _transcripts(spark, sf_dir), SITE)


@query(f"WITH {_HIT} SELECT coalesce(region, 'none') AS region, count(*) AS n FROM (SELECT DISTINCT contig, strand, st, en, transcript_id, region FROM hit) GROUP BY 1")
def region_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    named = F.explode(F.when(F.size("regions") == 0, F.array(F.lit("none"))).otherwise(F.col("regions"))).alias("region")
    return _annotated(spark, sf_dir).select(named).groupBy("region").agg(F.count("*").alias("n"))


# A gene none of whose regions is met counts as non_coding, beside what other genes have.
@query(
    f"""WITH {_HIT}, named AS (
        SELECT h.*, CASE WHEN contains(gene_name, 'gene') THEN gene_name ELSE gene_name || '|' || regexp_extract(transcript_id, '^(.*)\\.t', 1) END AS gene FROM hit h
    ), by_gene AS (
        SELECT contig, strand, st, en, gene, coalesce(list(DISTINCT region) FILTER (region IS NOT NULL), ['non_coding']) AS own, list(DISTINCT transcript_id) AS ids FROM named GROUP BY ALL
    ), flat AS (SELECT contig, strand, st, en, gene, unnest(own) AS region FROM by_gene), regions_ AS (
        SELECT contig, strand, st, en, string_agg(DISTINCT gene, ';' ORDER BY gene) AS gene_names, string_agg(DISTINCT region, ';' ORDER BY region) AS coding_regions FROM flat GROUP BY ALL
    ), ids AS (SELECT contig, strand, st, en, string_agg(DISTINCT transcript_id, ';' ORDER BY transcript_id) AS transcript_ids FROM named GROUP BY ALL)
    SELECT r.contig, r.strand, r.st AS start, r.en AS "end", gene_names, transcript_ids, coding_regions FROM regions_ r JOIN ids i ON r.contig = i.contig AND r.strand = i.strand AND r.st = i.st AND r.en = i.en"""
)
def annotation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, P16."""
    return annotation.rollup(_annotated(spark, sf_dir), SITE)


# ---- motifs ----

_FOUND = ", ".join(f"length(regexp_extract(w, '{motif_pattern(tracts, loops)}', 0)) AS m{k}" for k, (_, tracts, loops) in enumerate(MOTIF_KINDS))
_OF = {c: ", ".join(f"nullif(m{k}, 0)" for k, kind in enumerate(MOTIF_KINDS) if kind[0] == c) for c in MOTIF_CLASSES}
_SHORT = {c: f"list_min([{x}])" for c, x in _OF.items()}


def _search(seqs: str, id_: str, out: str) -> str:
    """SQL for the candidates of a table of sequences."""
    return f"""wins AS (
    SELECT {id_} AS id, e, substr(seq, greatest(e - 54, 0) + 1, e - greatest(e - 54, 0)) AS w FROM (SELECT {id_}, seq, unnest(range(11, length(seq))) AS e FROM {seqs})
), rich AS (
    SELECT * FROM wins WHERE right(w, 1) = 'G' AND length(w) - length(replace(w, 'G', '')) >= 8
), tried AS (
    SELECT id, e, {_FOUND} FROM rich
), classed AS (
    SELECT *, CASE {" ".join(f"WHEN {x} IS NOT NULL THEN {c}" for c, x in _SHORT.items())} END AS priority, coalesce({", ".join(_SHORT.values())}) AS short,
           list_max([{", ".join(f"m{k}" for k in range(len(MOTIF_KINDS)))}]) AS long FROM tried
), {out} AS (
    SELECT id, CAST(e AS INT) AS e, CAST(e - short AS INT) AS start, CAST(priority AS INT) AS priority, CAST(e - long AS INT) AS far FROM classed WHERE priority IS NOT NULL
)"""


_CANDIDATES = f"{lens.GENOME}, {_search('genome', 'contig', 'candidates')}"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.candidates(lens.genome(spark, sf_dir))


@query(f"WITH {_CANDIDATES} SELECT id, e, start, priority, far FROM candidates")
def motif_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, F12."""
    return _candidates(spark, sf_dir)


@query(f"WITH {_CANDIDATES} SELECT CASE priority WHEN 1 THEN 'canonical/G3L1-7' WHEN 2 THEN 'longloop' WHEN 3 THEN 'bulges' ELSE 'two-quartet' END AS class, count(*) AS n FROM candidates GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, P12."""
    names = F.create_map(*[F.lit(x) for kv in MOTIF_CLASSES.items() for x in kv])
    return _candidates(spark, sf_dir).groupBy(names[F.col("priority")].alias("class")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CANDIDATES}, s AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY far, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM candidates),
    g AS (SELECT *, sum(CASE WHEN far > top THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY far, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM s), c AS (SELECT id, g, min(far) AS start, max(e) AS "end" FROM g GROUP BY id, g)
    SELECT id, start, "end", CAST(row_number() OVER (PARTITION BY id ORDER BY start) AS INT) AS cluster FROM c"""
)
def motif_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return motif.clusters(_candidates(spark, sf_dir))


def _owners(seqs: str, id_: str, found: str, out: str) -> str:
    """SQL for the candidates that keep a cell of their sequence (needs WITH RECURSIVE): candidates from the right end on, each with the cells that are held
    as far as it, or a later one, can reach; those beyond are settled.
    low to top: the cells that it may claim; stop: the last of them that an equal or better one holds; more: how many Gs follow that it takes over."""
    run = lambda x: f"length({x}) - length(rtrim({x}, 'G'))"
    return f"""claims AS MATERIALIZED (
    SELECT f.id, f.e, f.priority AS rank, row_number() OVER (PARTITION BY f.id ORDER BY f.e DESC) AS k, greatest(f.e - 1 - ({run("left(s.seq, f.e - 1)")}), 0) AS low, least(f.e + 1, length(s.seq) - 1) AS top,
           {run("left(s.seq, f.e + 2)")} AS run, length(substr(s.seq, f.e + 3)) - length(ltrim(substr(s.seq, f.e + 3), 'G')) AS behind
    FROM {found} f JOIN {seqs} s ON f.id = s.{id_}
), steps AS MATERIALIZED (
    SELECT *, coalesce(lead(e + 1 + behind) OVER (PARTITION BY id ORDER BY k), -1) AS reach FROM claims
), walk AS (
    SELECT id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(p INT, e INT, rank INT)[]) AS cells, CAST([] AS INT[]) AS settled FROM (SELECT DISTINCT id FROM claims)
    UNION ALL
    SELECT id, k, list_filter(held, lambda c: c.p <= reach), list_distinct(list_transform(list_filter(held, lambda c: c.p > reach), lambda c: c.e))
    FROM (
        SELECT *, list_concat(list_filter(cells, lambda c: c.p <= stop OR c.p > top + more), list_transform(range(stop + 1, top + more + 1), lambda i: {{'p': CAST(i AS INT), 'e': CAST(e AS INT), 'rank': CAST(rank AS INT)}})) AS held
        FROM (
            SELECT *, CASE WHEN top = e + 1 AND len(list_filter(cells, lambda c: c.p > stop AND c.p <= top AND c.p >= e + 1 - run)) > 0 THEN behind ELSE 0 END AS more
            FROM (
                SELECT s.*, w.cells, coalesce(list_max(list_transform(list_filter(w.cells, lambda c: c.p >= s.low AND c.p <= s.top AND c.rank <= s.rank), lambda c: c.p)), s.low - 1) AS stop
                FROM walk w JOIN steps s ON s.id = w.id AND s.k = w.k + 1
            )
        )
    )
), {out} AS (SELECT DISTINCT id, unnest(settled) AS e FROM walk)"""


@query(
    f"""WITH RECURSIVE {_CANDIDATES}, {_owners('genome', 'contig', 'candidates', 'owners')}
    SELECT c.id, c.e, c.start, c.priority, c.far, CAST(greatest(c.start - 50, 0) AS INT) AS flank_start, CAST(least(c.e + 50, length(g.seq) - 1) AS INT) AS flank_end
    FROM candidates c JOIN owners o ON c.id = o.id AND c.e = o.e JOIN genome g ON g.contig = c.id"""
)
def motif_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, W9."""
    return motif.retained(lens.genome(spark, sf_dir)).select("id", "e", "start", "priority", "far", "flank_start", "flank_end")


def _known(spark: SparkSession, sf_dir: str) -> pipeline.Annotation:
    return pipeline.Annotation("lens", materialize(_transcripts(spark, sf_dir), "transcripts"), materialize(_exons(spark, sf_dir), "exons"))


def _motif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.motifs_of(_known(spark, sf_dir), _spliced(spark, sf_dir))


# The overlap of intervals of one gene, shown on the exons of its transcripts.
_NODES = f"{lens.GENES}, places AS (SELECT gene_id, contig, strand, transcript_id || '#' || CAST(e AS VARCHAR) AS node, st, en FROM exons)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.exons(spark, sf_dir).select("gene_id", "contig", "strand", F.concat("transcript_id", F.lit("#"), F.col("e").cast("string")).alias("node"), "start", "end")


@query(f"WITH {_NODES} SELECT a.node AS a, b.node AS b FROM places a JOIN places b ON a.gene_id = b.gene_id AND a.contig = b.contig AND a.strand = b.strand AND a.st < b.en AND b.st < a.en AND a.node < b.node")
def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps within a gene, on exons; J9 itself is motif_cluster_pairs."""
    return motif.overlapping_clusters(_places(spark, sf_dir))


_ROOTS = f"""RECURSIVE {_NODES}, pairs_ AS (
    SELECT a.node AS a, b.node AS b FROM places a JOIN places b ON a.gene_id = b.gene_id AND a.contig = b.contig AND a.strand = b.strand AND a.st < b.en AND b.st < a.en
), reach AS (SELECT a, b FROM pairs_ UNION SELECT r.a, p.b FROM reach r JOIN pairs_ p ON r.b = p.a), roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


@query(f"WITH {_ROOTS} SELECT node, root FROM roots")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components within a gene, on exons; A16 itself is motif_cluster_components."""
    places = materialize(_places(spark, sf_dir), "places")
    return motif.component_roots(places.select("node"), motif.overlapping_clusters(places))


@query(f"WITH {_ROOTS} SELECT r.root, min(p.st) AS start, max(p.en) AS \"end\", CASE WHEN count(DISTINCT p.strand) > 1 THEN '.' ELSE min(p.strand) END AS strand, count(*) AS n FROM roots r JOIN places p ON r.node = p.node GROUP BY r.root")
def group_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of components within a gene, on exons; A17 itself is motif_cluster_groups."""
    places = materialize(_places(spark, sf_dir), "places")
    roots = motif.component_roots(places.select("node"), motif.overlapping_clusters(places))
    strand = F.when(F.min("strand") != F.max("strand"), ".").otherwise(F.min("strand"))
    return places.join(roots, "node").groupBy("root").agg(F.min("start").alias("start"), F.max("end").alias("end"), strand.alias("strand"), F.count("*").alias("n"))


# Candidates of spliced transcripts, on the genome, near sites. Exons of the derived genes have 80 bases.
_PARTS = "CASE WHEN x.strand = '-' THEN x.en - least({b} - o, 80) ELSE x.st + greatest({a} - o, 0) END AS s, CASE WHEN x.strand = '-' THEN x.en - greatest({a} - o, 0) ELSE x.st + least({b} - o, 80) END AS e_"
_ORDER = "CASE WHEN strand = '-' THEN -s ELSE s END"


def _pieces_sql(name: str, a: str, b: str) -> str:
    """SQL for where [a, b) of each motif lies, touching parts joined: motif_id, i (from 1, 5' to 3'), s, e_."""
    return f"""{name}_cut AS (
    SELECT m.motif_id, x.contig, x.strand, {_PARTS.format(a=a, b=b)} FROM tx_motifs m JOIN (SELECT *, 80 * (e - 1) AS o FROM exons) x ON m.id = x.transcript_id WHERE {a} < o + 80 AND {b} > o AND {a} < {b}
), {name} AS (
    SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY motif_id) AS n FROM {name}_cut
)"""


def _json_sql(name: str) -> str:
    return f"""(SELECT motif_id, '[' || string_agg(concat('{{"start":', CAST(s AS VARCHAR), ',"end":', CAST(e_ AS VARCHAR), '}}'), ',' ORDER BY i) || ']' AS pieces, min(s) AS first, max(e_) AS last FROM {name} GROUP BY motif_id)"""


_MOTIF_ROWS = f"""WITH RECURSIVE {_SPLICED}, {_search('spliced', 'transcript_id', 'tx_found')}, {_owners('spliced', 'transcript_id', 'tx_found', 'owners')}, tx_motifs AS (
    SELECT f.*, f.id || '#' || CAST(f.e AS VARCHAR) AS motif_id, greatest(f.start - 50, 0) AS flank_start, least(f.e + 50, length(s.seq) - 1) AS flank_end, s.seq
    FROM tx_found f JOIN owners o ON f.id = o.id AND f.e = o.e JOIN spliced s ON f.id = s.transcript_id
), {_pieces_sql('body', 'm.start', 'm.e')}, {_pieces_sql('before', 'm.flank_start', 'm.start')}, {_pieces_sql('after', 'm.e', 'm.flank_end')}, {_UTR.replace(lens.GENES + ", ", "")}, regions AS (
    SELECT transcript_id, region, st, en FROM utr UNION ALL SELECT transcript_id, 'CDS', st, en FROM cds
), met AS (
    SELECT b.motif_id, list_sort(list_distinct(list(r.region))) AS names FROM body b JOIN tx_motifs m ON b.motif_id = m.motif_id JOIN regions r ON r.transcript_id = m.id AND b.s < r.en AND r.st < b.e_ GROUP BY b.motif_id
), flat AS (
    SELECT t.gene_id, t.gene_name, t.contig, t.strand, m.priority, b.pieces, b.first, b.last, coalesce(l.pieces, '[]') AS "left", coalesce(r.pieces, '[]') AS "right", m.id,
           '[' || coalesce((SELECT string_agg('"' || x || '"', ',') FROM (SELECT unnest(n.names) AS x)), '') || ']' AS names,
           substr(m.seq, m.start + 1, m.e - m.start) AS motif, substr(m.seq, m.flank_start + 1, m.start - m.flank_start) AS seq5, substr(m.seq, m.e + 1, m.flank_end - m.e) AS seq3
    FROM tx_motifs m JOIN transcripts t ON m.id = t.transcript_id JOIN {_json_sql('body')} b ON b.motif_id = m.motif_id
    LEFT JOIN {_json_sql('before')} l ON l.motif_id = m.motif_id LEFT JOIN {_json_sql('after')} r ON r.motif_id = m.motif_id LEFT JOIN met n ON n.motif_id = m.motif_id
)
SELECT contig, CAST(first AS INT) AS start, CAST(last AS INT) AS "end", gene_name || '|' || gene_id AS name, strand,
       CASE priority WHEN 1 THEN 'canonical/G3L1-7' WHEN 2 THEN 'longloop' WHEN 3 THEN 'bulges' ELSE 'two-quartet' END AS class, min(motif) AS sequence, pieces, min(seq5) || '|' || min(motif) || '|' || min(seq3) AS flank_sequence,
       '[' || string_agg(DISTINCT '{{"id":"' || id || '","regions":' || names || '}}', ',' ORDER BY '{{"id":"' || id || '","regions":' || names || '}}') || ']' AS transcripts, "left", "right", priority
FROM flat GROUP BY contig, first, last, gene_id, gene_name, strand, priority, "left", "right", pieces"""


@query(_MOTIF_ROWS)
def motif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained motifs of transcripts with where they and their flanks lie on the genome."""
    text = lambda c: F.to_json(c).alias(c)
    return _motif_rows(spark, sf_dir).select(*[text(c) if c in ("pieces", "left", "right", "transcripts") else c for c in ("contig", "start", "end", "name", "strand", "class", "sequence", "pieces", "flank_sequence", "transcripts", "left", "right", "priority")])


@query(_MOTIF_ROWS)
def parse_motif_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motif table as lines of text and back."""
    back = tables.motifs_of(_motif_rows(spark, sf_dir).select(tables.motif_line().alias("value")))
    return back.select(*[F.to_json(c).alias(c) if c in ("pieces", "left", "right", "transcripts") else c for c in back.columns])


_NEAR = f"""{_ISLANDS}, {_SPLICED}, {_search('spliced', 'transcript_id', 'tx_found')}, tx_motifs AS (
    SELECT f.*, f.id || '#' || CAST(f.e AS VARCHAR) AS motif_id, least(f.e + 50, length(s.seq) - 1) AS flank_end FROM tx_found f JOIN spliced s ON f.id = s.transcript_id
), {_pieces_sql('body', 'm.start', 'm.e')}, {_pieces_sql('flank', 'm.e', 'm.flank_end')}, zones AS (
    SELECT motif_id, contig, strand, CASE WHEN strand = '+' THEN e_ - 3 ELSE s END AS z0, CASE WHEN strand = '+' THEN e_ ELSE s + 3 END AS z1 FROM body WHERE i = CASE WHEN strand = '+' THEN n ELSE 1 END
    UNION ALL
    SELECT motif_id, contig, strand, CASE WHEN strand = '+' THEN s ELSE e_ - 3 END, CASE WHEN strand = '+' THEN s + 3 ELSE e_ END FROM flank WHERE i = 1
), near AS (
    SELECT DISTINCT i.contig, i.strand, i.st AS start, i.en AS "end", z.motif_id FROM islands i JOIN zones z ON i.contig = z.contig AND i.strand = z.strand AND i.st < z.z1 AND z.z0 < i.en
), spots AS (
    SELECT *, unnest(range(start, "end")) AS p FROM near
), inside AS (
    SELECT DISTINCT q.contig, q.strand, q.start, q."end", q.motif_id, q.p FROM spots q JOIN (SELECT motif_id, s, e_ FROM body UNION ALL SELECT motif_id, s, e_ FROM flank) b ON q.motif_id = b.motif_id AND b.s <= q.p AND q.p < b.e_
), held AS (
    SELECT contig, strand, start, "end", motif_id FROM inside GROUP BY ALL HAVING count(*) = "end" - start
), best AS (
    SELECT * FROM (SELECT h.*, m.priority, min(m.priority) OVER (PARTITION BY contig, strand, h.start, "end") AS b FROM held h JOIN tx_motifs m ON h.motif_id = m.motif_id) WHERE priority = b
), texts AS (
    SELECT motif_id, string_agg(concat(contig, ':', CAST(s AS VARCHAR), '-', CAST(e_ AS VARCHAR), ':', strand), ',' ORDER BY i) AS pieces, arg_max(s, i) AS last_s, arg_max(e_, i) AS last_e FROM body GROUP BY motif_id
), locus AS (
    SELECT * FROM (
        SELECT b.contig, b.strand, b.start, b."end", b.motif_id, b.priority, t.pieces, rank() OVER (PARTITION BY b.contig, b.strand, b.start, b."end" ORDER BY
            CASE WHEN strand = '+' THEN -last_e ELSE last_s END, CASE WHEN strand = '+' THEN last_s ELSE -last_e END, t.pieces) AS nth FROM best b JOIN texts t ON b.motif_id = t.motif_id
    ) WHERE nth = 1
), flanked AS (
    SELECT l.*, coalesce(f.length, 0) AS flank_length, coalesce(f.meets, 0) AS meets FROM locus l LEFT JOIN (
        SELECT l.contig AS c, l.strand AS st_, l.start AS s0, l."end" AS e0, l.motif_id AS m, sum(f.e_ - f.s) AS length, max(CASE WHEN f.s < l."end" AND l.start < f.e_ THEN 1 ELSE 0 END) AS meets
        FROM locus l JOIN flank f ON l.motif_id = f.motif_id GROUP BY ALL
    ) f ON l.motif_id = f.m AND l.contig = f.c AND l.strand = f.st_ AND l.start = f.s0 AND l."end" = f.e0
), chosen AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, strand, start, "end" ORDER BY meets DESC, flank_length DESC, motif_id) AS n_ FROM flanked) WHERE n_ = 1
)"""


# Clusters of candidates on spliced transcripts, and which of a gene overlap on the genome.
_CLUSTERS = f"""{_SPLICED}, {_search('spliced', 'transcript_id', 'tx_found')}, tops AS (
    SELECT *, max(e) OVER (PARTITION BY id ORDER BY far, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tx_found
), marked_ AS (
    SELECT *, sum(CASE WHEN far > top THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY far, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM tops
), clusters_ AS (
    SELECT id, min(far) AS start, max(e) AS e, CAST(row_number() OVER (PARTITION BY id ORDER BY min(far)) AS INT) AS cluster FROM marked_ GROUP BY id, g
), parts AS (
    SELECT x.gene_id, x.contig, x.strand, m.id, m.cluster, m.id || '#' || CAST(m.cluster AS VARCHAR) AS node, {_PARTS.format(a='m.start', b='m.e')}
    FROM clusters_ m JOIN (SELECT *, 80 * (e - 1) AS o FROM exons) x ON m.id = x.transcript_id WHERE m.start < o + 80 AND m.e > o
), nodes AS (
    SELECT gene_id, contig, strand, id, cluster, node, min(s) AS first, max(e_) AS last, string_agg(concat(contig, ':', CAST(s AS VARCHAR), '-', CAST(e_ AS VARCHAR), ':', strand), ',' ORDER BY {_ORDER}) AS pieces FROM parts GROUP BY ALL
), reps AS (
    SELECT node, min(node) OVER (PARTITION BY gene_id, contig, strand, pieces) AS rep FROM nodes
), meet AS (
    SELECT DISTINCT a.node AS a, b.node AS b FROM parts a JOIN parts b ON a.gene_id = b.gene_id AND a.contig = b.contig AND a.strand = b.strand AND a.s < b.e_ AND b.s < a.e_
)"""
_GROUPS = f"""RECURSIVE {_CLUSTERS}, reach AS (SELECT a, b FROM meet UNION SELECT r.a, p.b FROM reach r JOIN meet p ON r.b = p.a), roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


def _cluster_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = annotation.spliced(_exons(spark, sf_dir)).withColumnRenamed("transcript_id", "id").join(dealt(lens.transcripts(spark, sf_dir).select(F.col("transcript_id").alias("id"), "gene_id")), "id")
    return materialize(motif.cluster_places(motif.candidates(_spliced(spark, sf_dir), "transcript_id"), tx), "cluster-places")


@query(f"WITH {_CLUSTERS} SELECT gene_id, contig, strand, id, cluster, node, pieces FROM nodes")
def motif_cluster_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 on transcripts: each cluster of candidates where it lies on the genome, in pieces if it crosses a junction."""
    rows = _cluster_places(spark, sf_dir)
    return rows.withColumn("pieces", intervals.pieces_as_text(F.col("contig"), F.col("pieces"), F.col("strand")))


@query(f"WITH {_CLUSTERS}, own AS (SELECT DISTINCT rep FROM reps) SELECT a, b FROM meet WHERE a < b AND a IN (SELECT rep FROM own) AND b IN (SELECT rep FROM own)")
def motif_cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a gene any pieces of which overlap; of clusters with equal pieces the first stands for all."""
    return motif.overlapping_clusters(_cluster_places(spark, sf_dir))


@query(f"WITH {_CLUSTERS} SELECT node, rep FROM reps")
def motif_cluster_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cluster stands for those with equal pieces."""
    return motif.alike_clusters(_cluster_places(spark, sf_dir))


@query(f"WITH {_GROUPS} SELECT node, root FROM roots")
def motif_cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a gene that overlap, directly or through others."""
    places = _cluster_places(spark, sf_dir)
    return motif.component_roots(places.select("node"), motif.cluster_links(places))


@query(
    f"""WITH {_GROUPS}, bounds AS (
        SELECT n.gene_id, n.contig, r.root, min(n.first) AS start, max(n.last) AS "end", CASE WHEN min(n.strand) <> max(n.strand) THEN '.' ELSE min(n.strand) END AS strand, count(*) AS n,
               string_agg(n.id || '|' || n.pieces, ';' ORDER BY n.node) AS members
        FROM nodes n JOIN roots r ON n.node = r.node GROUP BY ALL
    ) SELECT gene_id, contig, start, "end", CAST(row_number() OVER (PARTITION BY gene_id ORDER BY start, "end", root) - 1 AS INT) AS "group", strand, root, n, members FROM bounds"""
)
def motif_cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups with their bounds and what they are made of."""
    places = _cluster_places(spark, sf_dir)
    groups = motif.cluster_groups(places, motif.component_roots(places.select("node"), motif.cluster_links(places)))
    text = lambda m: F.concat(m["id"], F.lit("|"), intervals.pieces_as_text(F.col("contig"), m["pieces"], F.col("strand")))
    return groups.withColumn("members", F.array_join(F.transform("members", text), ";"))


def _motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of spliced transcripts on the genome, so that SQL can follow; jobs take the retained ones."""
    seqs = _spliced(spark, sf_dir)
    tx = annotation.spliced(_exons(spark, sf_dir)).withColumnRenamed("transcript_id", "id")
    ends = seqs.select(F.col("transcript_id").alias("id"), F.length("seq").alias("n"), "seq")
    found = motif.candidates(seqs, "transcript_id").join(dealt(ends), "id")
    found = found.withColumn("flank_start", F.greatest(F.col("start") - 50, F.lit(0))).withColumn("flank_end", F.least(F.col("e") + 50, F.col("n") - 1))
    cut = lambda a, b: F.substring("seq", F.col(a) + 1, F.col(b) - F.col(a))
    found = found.withColumns({"sequence": cut("start", "e"), "flank_sequence": F.concat_ws("|", F.lit(""), F.lit(""), cut("e", "flank_end"))})
    rows = motif.placed(found.drop("n", "seq"), tx)
    named = F.concat("id", F.lit("#"), F.col("e").cast("string"))
    return materialize(rows.select("*", named.alias("motif_id"), named.alias("serial"), F.lit("x").alias("class")), "motifs")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.near_sites(_islands(spark, sf_dir).select(*SITE), _motifs(spark, sf_dir))


@query(f"WITH {_NEAR} SELECT contig, strand, start, \"end\", motif_id FROM near")
def site_motif_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, with the motif's and the flank's own pieces."""
    return _near(spark, sf_dir).select(*SITE, "motif_id")


@query(f"WITH {_NEAR} SELECT contig, strand, start, \"end\", motif_id FROM held")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sites that lie in a motif and the flank after it."""
    return _near(spark, sf_dir).where(motif.contains_site()).select(*SITE, "motif_id")


@query(f"WITH {_NEAR} SELECT contig, strand, start, \"end\", motif_id, priority FROM best")
def class_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    return motif.best_class(_near(spark, sf_dir), SITE).select(*SITE, "motif_id", "priority")


@query(f"WITH {_NEAR} SELECT contig, strand, start, \"end\", motif_id, pieces FROM locus")
def locus_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, and the choice of one row of a group."""
    rows = motif.best_locus(motif.best_class(_near(spark, sf_dir), SITE), SITE)
    return rows.select(*SITE, "motif_id", intervals.pieces_as_text(F.col("contig"), F.col("pieces"), F.col("strand")).alias("pieces"))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.representative(motif.best_locus(motif.best_class(_near(spark, sf_dir), SITE), SITE), SITE)


@query(f"WITH {_NEAR} SELECT contig, strand, start, \"end\", motif_id FROM chosen")
def representative_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10."""
    return _chosen(spark, sf_dir).select(*SITE, "motif_id")


@query(
    f"""WITH {_NEAR}, drawn AS (
        SELECT c.contig, c.strand, c.start, c."end", c.motif_id, 1 AS part, row_number() OVER (PARTITION BY c.contig, c.strand, c.start, c."end" ORDER BY CASE WHEN c.strand = '-' THEN -p ELSE p END) AS nth, p
        FROM chosen c JOIN (SELECT motif_id, unnest(range(s, e_)) AS p FROM body) b ON c.motif_id = b.motif_id
        UNION ALL
        SELECT * FROM (SELECT c.contig, c.strand, c.start, c."end", c.motif_id, 2, row_number() OVER (PARTITION BY c.contig, c.strand, c.start, c."end" ORDER BY CASE WHEN c.strand = '-' THEN -p ELSE p END) AS nth, p
        FROM chosen c JOIN (SELECT motif_id, unnest(range(s, e_)) AS p FROM flank) b ON c.motif_id = b.motif_id) WHERE nth <= 10
    ), starred AS (
        SELECT d.contig, d.strand, d.start, d."end", d.part, d.nth, max(CASE WHEN h.cond = 'K' THEN 1 ELSE 0 END) AS k, max(CASE WHEN h.cond = 'KPDS' THEN 1 ELSE 0 END) AS kpds
        FROM drawn d LEFT JOIN hits h ON h.contig = d.contig AND h.strand = d.strand AND h.st <= d.p AND d.p < h.en AND d.p >= d.start AND d.p < d."end" GROUP BY ALL
    ), lines AS (
        SELECT contig, strand, start, "end", string_agg(CASE WHEN k = 1 THEN '*' ELSE '-' END, '' ORDER BY part, nth) AS k, string_agg(CASE WHEN kpds = 1 THEN '*' ELSE '-' END, '' ORDER BY part, nth) AS kpds FROM starred GROUP BY ALL
    ) SELECT l.contig, l.strand, l.start, l."end", concat('            5', chr(39), '- ', substr(s.seq, m.start + 1, m.e - m.start), left(substr(s.seq, m.e + 1, m.flank_end - m.e), 10), ' -3', chr(39), chr(10), '       rG4seq-K ', l.k, chr(10), '    rG4seq-KPDS ', l.kpds) AS picture
    FROM lines l JOIN chosen c ON l.contig = c.contig AND l.strand = c.strand AND l.start = c.start AND l."end" = c."end" JOIN tx_motifs m ON c.motif_id = m.motif_id JOIN spliced s ON s.transcript_id = m.id"""
)
def diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, of sites with a motif."""
    marks = sites.marks(_islands(spark, sf_dir), _hits(spark, sf_dir))
    rows = _chosen(spark, sf_dir).join(dealt(marks), SITE, "left").withColumn("flank", F.split("flank_sequence", r"\|")[2])
    lines = sites.picture_lines(["K", "KPDS"], [1, 2], False)
    return rows.select(*SITE, sites.picture(F.col("pieces"), F.col("right"), F.col("sequence"), F.col("flank"), F.col("strand"), lines).alias("picture"))


@query(f"WITH {_NEAR} SELECT h.contig, h.strand, h.cond, h.rep, h.pos FROM hits h WHERE EXISTS (SELECT 1 FROM zones z WHERE z.contig = h.contig AND z.strand = h.strand AND h.pos >= z.z0 AND h.pos < z.z1)")
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops in a motif's 3' zone."""
    z = motif.zones(_motifs(spark, sf_dir)).select("contig", "strand", F.col("z_start").alias("start"), F.col("z_end").alias("end"))
    return intervals.points_within(_hits(spark, sf_dir), z, 64).select("contig", "strand", "cond", "rep", "pos")


REPORT_FDR = 0.5


@query()
def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, D16: the whole job on the derived tables, from signal to the combined report: whitelist, motifs, cutoffs,
    rescue, support, choice of motifs, picture and annotation. Stops of the derived tables have nothing to do with their sequence,
    so half of what is called may be false here; at lower rates hardly a stop of KPDS-2 is called, and no site has support."""
    tiles, known = tiled(spark, sf_dir), _known(spark, sf_dir)
    sequences = _spliced(spark, sf_dir)
    allowed = materialize(pipeline.whitelist(known.exons, sequences, tiles), "whitelist")
    motifs = pipeline.serial(pipeline.motifs_of(known, sequences).withColumn("nth", F.lit(0)))
    rows = materialize(pipeline.marked(_signal(spark, sf_dir, True).where("not decoy"), allowed, tiles), "marked")
    hits = materialize(pipeline.calls(rows, motifs, tiles, REPORT_FDR), "hits")
    found = materialize(sites.site_islands(hits).where(sites.is_supported(F.col("ids"))), "sites")
    done = report.described(found, hits, motifs, tiles, [("lens", known.transcripts)])
    return report.report(done, ["lens"], ["K", "KPDS"], [1, 2])
