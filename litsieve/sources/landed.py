"""Sources (S1-S9): landed bibliographic payloads -> the paper table.

Live HTTP fetching is not part of this library; API responses are landed as files (one EFetch
XML, Atom XML or Crossref JSON document per file) and read here as distributed Spark scans with
explicit schemas (the XML reader's inferred types flip with the data, so a schema is always
passed). Malformed records are split off into a quarantine frame, the rest of the batch is kept.

Ids: ``paper_id`` is a record's place in the order of the records' SHA-256 digests, from 0. It
depends on the records alone, not on files, splits or partitions; equal records get neighbouring
ids. Records are range-partitioned by digest and checkpointed once, so later stages see fixed ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from litsieve.constants import ARXIV_DATE_FORMAT, DEFAULT_MAX_RESULTS, MAX_RESULTS_RANGE, PREVIEW_ROWS
from litsieve.functions.text import py_strip
from litsieve.operators.association import with_running_sum
from litsieve.schema import PAPER_COLUMNS
from litsieve.session import cut_lineage

CORRUPT = "_corrupt_record"
ID_SALTS = 4096  # equal records are spread over so many sort keys


def _s(name, t=None, nullable=True):
    return StructField(name, t or StringType(), nullable)


PUBMED_SCHEMA = StructType([
    _s("MedlineCitation", StructType([
        _s("Article", StructType([
            _s("ArticleTitle"),
            _s("Abstract", StructType([_s("AbstractText", ArrayType(StringType()))])),
            _s("Journal", StructType([_s("JournalIssue", StructType([
                _s("PubDate", StructType([_s("Year"), _s("MedlineDate")]))]))])),
        ])),
    ])),
    _s("PubmedData", StructType([_s("ArticleIdList", StructType([
        _s("ArticleId", ArrayType(StructType([_s("_VALUE"), _s("_IdType")])))]))])),
    _s(CORRUPT),
])

ATOM_SCHEMA = StructType([_s("title"), _s("summary"), _s("published"), _s("arxiv:doi"), _s(CORRUPT)])

CROSSREF_SCHEMA = StructType([
    _s("message", StructType([_s("items", ArrayType(StructType([
        _s("title", ArrayType(StringType())),
        _s("abstract"),
        _s("abstracts", ArrayType(StructType([_s("text")]))),
        _s("created", StructType([_s("date-parts", ArrayType(ArrayType(IntegerType())))])),
        _s("published", StructType([_s("date-parts", ArrayType(ArrayType(IntegerType())))])),
        _s("DOI"),
    ])))])),
    _s(CORRUPT),
])


#: The inline markup elements of bibliographic titles; any other "<...>" is text.
INLINE_TAGS = "(?i)</?(?:i|b|u|em|strong|sub|sup|sc|tt|small|italic|bold|underline)(?:\\s[^<>]*)?/?>"


def _strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, INLINE_TAGS, "")


def _clean(c: Column) -> Column:
    """Missing -> '' (API rows use empty strings), else outer-stripped text."""
    return F.coalesce(py_strip(c), F.lit(""))


def record_digest() -> Column:
    """SHA-256 of the five paper columns, NULL and '' told apart."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0000")) for c in PAPER_COLUMNS]), 256)


def _with_ids(df: DataFrame) -> DataFrame:
    # the salt only spreads equal records over partitions; which of them gets which id makes no difference
    keyed = df.select(record_digest().alias("__digest"),
                      F.pmod(F.monotonically_increasing_id(), F.lit(ID_SALTS)).alias("__salt"),
                      F.lit(1).cast("long").alias("__one"), *PAPER_COLUMNS)
    return with_running_sum(keyed, ["__digest", "__salt"], "__one", "paper_id").select("paper_id", *PAPER_COLUMNS)


def _read(raw: DataFrame, mapping, with_quarantine: bool):
    """``mapping`` of the well-formed records, with ids; with_quarantine also gives the malformed records.

    Spark refuses queries that read only the corrupt-record column of a raw file, so where that is asked for
    the parsed batch is persisted until both results are checkpointed.
    """
    if not with_quarantine:
        return _with_ids(mapping(raw.filter(F.col(CORRUPT).isNull())))
    parsed = raw.persist(StorageLevel.MEMORY_AND_DISK)
    papers = _with_ids(mapping(parsed.filter(F.col(CORRUPT).isNull())))
    bad = cut_lineage(parsed.filter(F.col(CORRUPT).isNotNull()))
    parsed.unpersist()
    return papers, bad


def read_pubmed(spark: SparkSession, path: str, with_quarantine: bool = False):
    """S3: PubMed EFetch XML -> papers. First ArticleTitle (tags stripped), first AbstractText
    only, PubDate/Year (absent -> ''), first ArticleId with IdType 'doi'; Source 'PubMed'."""
    raw = (spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).schema(PUBMED_SCHEMA).load(path))
    art = F.col("MedlineCitation.Article")
    dois = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == F.lit("doi"))
    return _read(raw, lambda good: good.select(
        _clean(_strip_tags(art["ArticleTitle"])).alias("Title"),
        _clean(F.get(art["Abstract"]["AbstractText"], 0)).alias("Abstract"),
        F.coalesce(art["Journal"]["JournalIssue"]["PubDate"]["Year"], F.lit("")).alias("Year"),
        F.coalesce(F.get(dois, 0)["_VALUE"], F.lit("")).alias("DOI"),
        F.lit("PubMed").alias("Source"),
    ), with_quarantine)


def read_arxiv(spark: SparkSession, path: str, with_quarantine: bool = False):
    """arXiv Atom entries -> papers. Year of ``published`` in yyyy-MM-ddTHH:mm:ssZ (bad
    date -> ''); the DOI is read from ``arxiv:doi`` where Atom puts it (B14)."""
    raw = (spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).schema(ATOM_SCHEMA).load(path))
    ts = F.try_to_timestamp(py_strip(F.col("published")), F.lit(ARXIV_DATE_FORMAT))
    return _read(raw, lambda good: good.select(
        _clean(F.col("title")).alias("Title"),
        _clean(F.col("summary")).alias("Abstract"),
        F.coalesce(F.year(ts).cast("string"), F.lit("")).alias("Year"),
        F.coalesce(py_strip(F.col("`arxiv:doi`")), F.lit("")).alias("DOI"),
        F.lit("arXiv").alias("Source"),
    ), with_quarantine)


def read_crossref(spark: SparkSession, path: str, with_quarantine: bool = False, multi_line: bool = True):
    """Crossref works JSON -> papers. title[0]; abstract else abstracts[0].text; year from
    published date-parts, else created (B14); DOI; Source 'Crossref'.

    ``multi_line`` reads one (pretty-printed) response per file; set it to False for JSON Lines
    (one response per line), which splits across tasks."""
    raw = (spark.read.schema(CROSSREF_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    it = F.col("it")

    def year_of(field):
        return F.get(F.get(it[field]["date-parts"], 0), 0).cast("string")

    return _read(raw, lambda good: good.select(F.explode("message.items").alias("it")).select(
        _clean(F.get(it["title"], 0)).alias("Title"),
        _clean(F.coalesce(it["abstract"], F.get(it["abstracts"], 0)["text"])).alias("Abstract"),
        F.coalesce(year_of("published"), year_of("created"), F.lit("")).alias("Year"),
        F.coalesce(it["DOI"], F.lit("")).alias("DOI"),
        F.lit("Crossref").alias("Source"),
    ), with_quarantine)


def read_csv_table(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV upload with a header row (quoted commas allowed). ``multi_line`` allows newlines inside quotes,
    at one task a file; without it files are split across tasks."""
    return (spark.read.option("header", True).option("inferSchema", infer).option("multiLine", multi_line)
            .option("escape", '"').csv(path))


def read_papers_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 for paper metadata: the five paper columns as text, ids assigned at ingest."""
    raw = read_csv_table(spark, path, infer=False)
    missing = [c for c in PAPER_COLUMNS if c not in raw.columns]
    for c in missing:
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    return _with_ids(raw.select(*[F.col(c).cast("string") for c in PAPER_COLUMNS]))


def cap_rows(df: DataFrame, max_results: int = DEFAULT_MAX_RESULTS, order_by: str = "paper_id") -> DataFrame:
    """The first ``max_results`` rows (1-1000) in a stable order."""
    if not MAX_RESULTS_RANGE[0] <= max_results <= MAX_RESULTS_RANGE[1]:
        raise ValueError("max_results must be 1-1000")
    return df.orderBy(order_by).limit(max_results)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Several sources screened together, ids re-assigned to stay unique."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(*PAPER_COLUMNS) for f in frames])
    return _with_ids(merged)


def read_each(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every source by itself. A source whose reading fails gives an empty paper table and a row
    (source, error class) in the second result; the others are read as usual."""
    frames, failed = {}, []
    for name, read in readers.items():
        try:
            frames[name] = read()
        except (PySparkException, Py4JError) as e:
            frames[name] = spark.createDataFrame([], "paper_id long, " + ", ".join(f"`{c}` string" for c in PAPER_COLUMNS))
            failed.append((name, (e.getCondition() if isinstance(e, PySparkException) else None) or type(e).__name__))
    return frames, spark.createDataFrame(failed, "source string, error string")


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: str = "paper_id") -> DataFrame:
    """First rows in id order."""
    return df.orderBy(order_by).limit(n)
