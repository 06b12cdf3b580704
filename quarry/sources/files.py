"""Readers: markdown papers and briefs, bibliographic exports, citation tables, lists, plans and batch results.

Every reader goes through Spark's own file sources, so any store works; parsing is column expressions over whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values.
SECTION_LABELS = {
    "question & context": "question_context", "empirical context": "empirical_context", "literature drawn on": "literature", "methods": "methods",
    "arguments": "arguments", "key conclusions": "conclusions", "discussion items": "discussion",
}
BRIEF_FIELDS = {
    "question": r"Question\s*&\s*context", "empirical": r"Empirical\s*context", "literature": r"Literature\s*drawn\s*on", "methods": "Methods",
    "arguments": "Arguments", "conclusions": r"Key\s*conclusions", "discussion": r"Discussion\s*items",
}
TOP_BULLET = r"^-\s+\*\*([^*]+?):\*\*\s*(.*)$"
WORKS = "base string, doi string, ext_id string, title string, authors string, venue string, year string, type string, cited_by_count string, concepts string, match_confidence string, found_through string"
CITATIONS = "citing_base string, cited_ext_id string, cited_doi string, cited_title string, cited_authors string, cited_year string, cited_base string"
# End of fixed values.


def whole_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, modified, text of the files below a folder."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return read.select("path", X.last_component(F.col("path")).alias("name"), F.col("modificationTime").alias("modified"), F.expr("decode(content, 'UTF-8')").alias("text"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """stem, chapter, text_path, text_mtime, title, text of prepared texts."""
    found = whole_files(spark, folder, "text_*.md")
    key = X.text_key_of(F.col("name"))
    return found.select(key["stem"].alias("stem"), key["chapter"].alias("chapter"), F.col("path").alias("text_path"), F.col("modified").cast("double").alias("text_mtime"), X.title_from_text(F.col("text")).alias("title"), "text")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """stem, chapter, sum_path, sum_mtime, title and the seven labelled sections."""
    found = whole_files(spark, folder, "sum_*.md")
    key, parts = X.summary_key(F.col("name")), sections(F.col("text"))
    return found.select(
        key["stem"].alias("stem"), key["chapter"].alias("chapter"), F.col("path").alias("sum_path"), F.col("modified").cast("double").alias("sum_mtime"), X.title_from_summary(F.col("text")).alias("title"),
        *[F.coalesce(parts[name], F.lit("")).alias(name) for name in SECTION_LABELS.values()],
    )


def sections(text: Column) -> Column:
    """Map from section to its text, by labelled top bullets; an unknown label drops what follows."""
    names = F.create_map(*[F.lit(x) for pair in SECTION_LABELS.items() for x in pair])
    none = F.array().cast("array<struct<k:string,v:string>>")
    start = F.struct(none.alias("out"), F.lit(None).cast("string").alias("now"))

    def step(s: Column, line: Column) -> Column:
        bullet = line.rlike(TOP_BULLET)
        label = names[F.lower(X.strip(F.regexp_extract(line, TOP_BULLET, 1)))]
        rest = X.strip(F.regexp_extract(line, TOP_BULLET, 2))
        plain = F.replace(F.regexp_replace(F.regexp_replace(X.strip(line), r"^[-*]\s+", ""), r"^\d+\.\s+", ""), F.lit("**"), F.lit(""))
        put = lambda k, v: F.concat(s["out"], F.array(F.struct(k.alias("k"), v.alias("v"))))
        return (
            F.when(bullet & label.isNotNull(), F.struct(put(label, rest).alias("out"), label.alias("now")))
            .when(bullet, F.struct(s["out"].alias("out"), F.lit(None).cast("string").alias("now")))
            .when(s["now"].isNotNull() & (X.strip(line) != ""), F.struct(put(s["now"], plain).alias("out"), s["now"].alias("now")))
            .otherwise(s)
        )

    rows = F.aggregate(F.split(text, "\r?\n"), start, step)["out"]
    keys = F.array_distinct(F.transform(rows, lambda r: r["k"]))
    joined = F.transform(keys, lambda k: F.struct(k, X.collapse(F.array_join(F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["v"]), " "))))
    return F.map_from_entries(joined)


def brief(text: Column) -> dict[str, Column]:
    """Columns of a brief: source_file, title, the labelled fields, and the arguments as a list."""
    any_label = "|".join(BRIEF_FIELDS.values())
    field = lambda p: X.strip(F.regexp_extract(text, rf"(?s)(?:^|\n)- \*\*{p}:\*\*\s*(.*?)(?=\n- \*\*(?:{any_label}):\*\*|$)", 1))
    out = {"source_file": X.strip(F.get(F.split(text, "\r?\n"), F.lit(0))), "title": X.strip(F.regexp_extract(text, r"(?m)^## (.*)$", 1))}
    out |= {name: field(p) for name, p in BRIEF_FIELDS.items()}
    out["arguments_text"] = out.pop("arguments")
    items = F.filter(F.transform(F.split(out["arguments_text"], r"\n\s*\d+\.\s+"), X.strip), lambda x: x != "")
    return out | {"arguments": items}


def briefs(spark: SparkSession, folder: str) -> DataFrame:
    """base and the columns of each brief that has a template."""
    found = whole_files(spark, folder, "sum_*.md").filter(X.has_template(F.col("text")))
    return found.select(F.regexp_replace(_bare(F.col("name")), "^sum_", "").alias("base"), F.col("path").alias("sum_path"), *[c.alias(n) for n, c in brief(F.col("text")).items()])


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Briefs with the paths of their rundown and quotes, if there are any."""
    out = briefs(spark, folder)
    for kind in ("para", "quote"):
        other = whole_files(spark, folder, f"{kind}_*.md").select(F.regexp_replace(_bare(F.col("name")), f"^{kind}_", "").alias("base"), F.col("path").alias(f"{kind}_path"))
        out = out.join(other, "base", "left")
    return out


def rundown(spark: SparkSession, folder: str) -> DataFrame:
    """base, pos, sentence from numbered lines."""
    found = whole_files(spark, folder, "para_*.md")
    lines = F.filter(F.split("text", "\r?\n"), lambda x: x.rlike(r"^\s*\d+\.\s+.+"))
    return found.select(F.regexp_replace(_bare(F.col("name")), "^para_", "").alias("base"), F.posexplode(F.transform(lines, lambda x: X.strip(F.regexp_replace(x, r"^\s*\d+\.\s+", "")))).alias("pos", "sentence"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file; blank lines and comments don't count."""
    line = X.strip(F.col("value"))
    found = spark.read.text(path).select(line.alias("base")).filter((F.col("base") != "") & ~F.startswith("base", F.lit("#"))).distinct()
    if not found.limit(1).count():
        raise ValueError(f"{path} names no papers")
    return found


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, JSON lines, or one JSON document, by suffix; missing keys are null."""
    if path.endswith(".csv"):
        found = spark.read.csv(path, header=True, multiLine=True, escape='"')
        found = found.withColumnsRenamed({c: c.lstrip("﻿") for c in found.columns})
    elif path.endswith((".jsonl", ".ndjson")):
        found = spark.read.schema(schema).json(path)
    elif path.endswith(".json"):
        found = spark.read.schema(schema).json(path, multiLine=True)
    else:
        raise ValueError(f"{path} is neither CSV nor JSON")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return found.select(*[(F.col(n) if n in found.columns else F.lit(None).cast("string")).alias(n) for n in names])


def works(spark: SparkSession, path: str) -> DataFrame:
    """Works with numbers coerced; a blank confidence is 1 (B01's input)."""
    found = records(spark, path, WORKS)
    text = [X.null_text(F.col(c)).alias(c) for c in found.columns if c not in ("year", "cited_by_count", "match_confidence")]
    return found.select(*text, X.try_int(F.col("year")).alias("year"), X.try_int(F.col("cited_by_count")).alias("cited_by_count"), X.try_double(F.col("match_confidence"), 1.0).alias("match_confidence"))


def citations(spark: SparkSession, path: str) -> DataFrame:
    found = records(spark, path, CITATIONS)
    text = [X.null_text(F.col(c)).alias(c) for c in found.columns if c != "cited_year"]
    return found.select(*text, X.try_int(F.col("cited_year")).alias("cited_year")).filter("citing_base is not null")


def csl(spark: SparkSession, path: str) -> DataFrame:
    """title, doi, authors (surnames) of CSL JSON."""
    found = spark.read.schema("title string, DOI string, author array<struct<family:string>>").json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return found.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("DOI", F.lit("")).alias("doi"), F.coalesce(F.transform("author", lambda a: F.coalesce(a["family"], F.lit(""))), none).alias("authors")
    )


def bibtex(text: Column) -> Column:
    """Array of struct(title, doi, authors) of a BibTeX export with one field a line."""
    entries = F.slice(F.split(F.concat(F.lit("\n"), text), "\n@"), 2, 1 << 30)

    def value(entry: Column, key: str) -> Column:
        raw = F.regexp_extract(entry, rf"(?im)^\s*{key}\s*=\s*(.*?),?\s*$", 1)
        return F.btrim(F.regexp_replace(raw, "[{}]", ""), F.lit('"'))

    surname = lambda a: X.strip(F.substring_index(a, ",", 1))
    return F.transform(
        entries,
        lambda e: F.struct(
            value(e, "title").alias("title"), value(e, "doi").alias("doi"),
            F.when(value(e, "author") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(value(e, "author"), " and "), surname)).alias("authors"),
        ),
    )


def ris(text: Column) -> Column:
    """Array of struct(title, doi, authors) of an RIS export; a record counts once it is closed."""
    chunks = F.split(text, r"(?m)^ER.*$")
    closed = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    none = F.array().cast("array<string>")

    def tagged(chunk: Column, tags: str) -> Column:
        return F.transform(F.filter(F.split(chunk, "\r?\n"), lambda x: x.rlike(f"^(?:{tags})")), lambda x: X.strip(F.substring(x, 7, 1 << 30)))

    return F.transform(
        closed,
        lambda c: F.struct(
            F.coalesce(F.get(F.filter(tagged(c, "TI|T1"), lambda t: t != ""), F.lit(0)), F.lit("")).alias("title"),
            F.coalesce(F.try_element_at(tagged(c, "DO"), F.lit(-1)), F.lit("")).alias("doi"),
            F.coalesce(F.transform(tagged(c, "AU"), lambda a: X.strip(F.substring_index(a, ",", 1))), none).alias("authors"),
        ),
    )


def reference_export(spark: SparkSession, path: str) -> DataFrame:
    """pos, title, doi, authors of a reference manager's export, by suffix."""
    from ..operators.vector import global_rank

    if path.endswith(".json"):
        found = csl(spark, path).withColumn("__at", F.monotonically_increasing_id())
        return global_rank(found, [F.col("__at")]).select((F.col("rank") - 1).alias("pos"), "title", "doi", "authors")
    for suffix, parse in ((".bib", bibtex), (".ris", ris)):
        if path.endswith(suffix):
            return spark.read.text(path, wholetext=True).select(F.posexplode(parse(F.col("value"))).alias("pos", "r")).select("pos", "r.*")
    raise ValueError("exports are CSL JSON, BibTeX or RIS")


def plan(text: Column) -> Column:
    """Array of struct(number, move, text) of a plan's items; lines that follow belong to the item."""
    rule = r"^(\d+)\.\s+\[([A-Z_\-–— ]+)\]\s*[:—\-–]?\s*(.+)$"
    none = F.array().cast("array<struct<number:int,move:string,text:string>>")

    def step(done: Column, raw: Column) -> Column:
        line, last = X.strip(raw), F.try_element_at(done, F.lit(-1))
        opened = F.struct(F.regexp_extract(line, rule, 1).try_cast("int").alias("number"), F.regexp_extract(line, rule, 2).alias("move"), X.collapse(F.regexp_extract(line, rule, 3)).alias("text"))
        longer = F.struct(last["number"].alias("number"), last["move"].alias("move"), F.concat(last["text"], F.lit(" "), X.collapse(line)).alias("text"))
        return (
            F.when(line.rlike(rule), F.concat(done, F.array(opened)))
            .when((line != "") & (F.size(done) > 0), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)))
            .otherwise(done)
        )

    return F.aggregate(F.split(text, "\r?\n"), none, step)


def map_threads(text: Column) -> Column:
    """Array of struct(thread, key) of the works listed under each numbered section of a map."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n## (?=\d+\. )"), 2, 1 << 30)
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.filter(F.split(F.regexp_extract(p, r"(?s)\*\*Works[^\n]*\n(.*)$", 1), "\n"), lambda x: x.rlike(r"^- .+ - .+")),
                lambda x: F.struct(X.strip(F.regexp_extract(p, r"^\d+\. ([^\n]*)", 1)).alias("thread"), F.lower(X.strip(F.substring(x, 3, 1 << 30))).alias("key")),
            ),
        )
    )


def draft_sections(text: Column) -> Column:
    """Array of struct(title, text) by # headings; without any, paragraphs in fours."""
    titled = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6}\s+\S)"), lambda x: X.strip(x) != "")
    made = F.transform(
        titled,
        lambda x: F.struct(
            F.regexp_extract(X.strip(x), r"^#{1,6}\s+([^\n]*)", 1).alias("title"),
            X.strip(F.regexp_replace(X.strip(x), r"^#{1,6}\s+[^\n]*\n?", "")).alias("text"),
        ),
    )
    paras = F.filter(F.transform(F.split(text, r"\n\s*\n"), X.strip), lambda x: x != "")
    fours = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(paras) - 1) / 4).cast("int"), F.lit(0))),
        lambda i: F.struct(F.concat(F.lit("Part "), (i + 1).cast("string")).alias("title"), F.array_join(F.slice(paras, i * 4 + 1, F.lit(4)), "\n\n").alias("text")),
    )
    whole = F.array(F.struct(F.lit("").alias("title"), X.strip(text).alias("text")))
    return F.when(F.concat(F.lit("\n"), text).rlike(r"\n#{1,6}\s+\S"), made).when(F.size(paras) > 4, fours).otherwise(whole)


def detect_cited(draft: Column, authors: Column) -> Column:
    """Whether some word of over three characters of the authors stands in the draft."""
    return F.exists(F.filter(F.split(authors, r"\s+"), lambda w: F.length(w) > 3), lambda w: F.contains(F.lower(draft), F.lower(w)))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, text of the results that succeeded."""
    schema = "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>>"
    found = spark.read.schema(schema).json(path).filter("result.type = 'succeeded'")
    blocks = F.filter("result.message.content", lambda b: b["type"] == "text")
    return found.select("custom_id", F.array_join(F.transform(blocks, lambda b: b["text"]), "").alias("text"))


def discover(files: DataFrame, excluded: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """One file for each stem, a text before a PDF (S30); rows (path, name)."""
    found = files.withColumn("stem", X.stem_of(F.col("name"))).withColumn("__pdf", F.lower("name").endswith(".pdf").cast("int"))
    if excluded is not None:
        found = found.join(excluded, "name", "left_anti")
    if only is not None:
        found = found.join(only, "name", "left_semi")
    return found.groupBy("stem").agg(F.min_by(F.struct("path", "name"), F.struct("__pdf", "path")).alias("f")).select("stem", "f.*")
