"""Readers and writers of text formats as DataFrames of records.

Files are read whole, one row each, by Spark's own reader, so any file system
that Spark reaches will do; parsing is expressions or one Arrow stage.
"""

from __future__ import annotations

import configparser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.alphabet import encode
from seqlake.operators import significance as sig


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, value): the whole text of each file."""
    return spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")


def fasta_sequences(texts: DataFrame) -> DataFrame:
    """(msa_id, seq_id, description, residues) of aligned FASTA; sequences may span lines.

    Sequences of unequal length, or without a header, are an error.
    """
    lines = F.regexp_replace("value", "\r", "")
    blocks = F.filter(F.split(F.concat(F.lit("\n"), lines), "\n>"), lambda x: F.trim(x) != "")
    rows = texts.select("name", F.posexplode(blocks).alias("seq_id", "block"))
    rows = rows.select(
        F.col("name").alias("msa_id"), "seq_id", F.trim(F.substring_index("block", "\n", 1)).alias("description"),
        F.regexp_replace(F.expr("substring(block, instr(concat(block, '\n'), '\n') + 1)"), r"\s", "").alias("residues"),
    )
    sizes = rows.groupBy("msa_id").agg(F.min(F.length("residues")).alias("low"), F.max(F.length("residues")).alias("high"))
    checked = rows.join(sizes, "msa_id")
    bad = F.raise_error(F.concat(F.lit("sequences of unequal length in "), "msa_id")).cast("string")
    return checked.select("msa_id", "seq_id", "description", F.when(F.col("low") == F.col("high"), F.col("residues")).otherwise(bad).alias("residues"))


def stockholm_sequences(texts: DataFrame, keep_case: bool = False) -> DataFrame:
    """The same of Stockholm 1.0: interleaved blocks, the first alignment of each file. Dots are gaps, unless the case is kept."""
    first = F.substring_index(F.regexp_replace("value", "\r", ""), "\n//", 1)
    lines = texts.select(F.col("name").alias("msa_id"), F.posexplode(F.split(first, "\n")).alias("line", "text"))
    named = F.regexp_extract("text", r"^#=GS\s+(\S+)\s+DE\s+(.*)$", 2)
    notes = lines.filter(F.col("text").startswith("#=GS")).select("msa_id", F.regexp_extract("text", r"^#=GS\s+(\S+)", 1).alias("seq"), named.alias("description"))
    notes = notes.filter("description <> ''").groupBy("msa_id", "seq").agg(F.min("description").alias("description"))
    rows = lines.filter(~F.col("text").startswith("#") & (F.trim("text") != ""))
    rows = rows.select("msa_id", "line", F.regexp_extract("text", r"^(\S+)\s+(\S+)", 1).alias("seq"), F.regexp_extract("text", r"^(\S+)\s+(\S+)", 2).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"])
    whole = rows.groupBy("msa_id", "seq").agg(F.array_join(parts, "").alias("residues"), F.min("line").alias("line"))
    from pyspark.sql import Window

    seq_id = F.row_number().over(Window.partitionBy("msa_id").orderBy("line")) - 1
    return whole.join(notes, ["msa_id", "seq"], "left").select("msa_id", seq_id.alias("seq_id"), F.coalesce("description", "seq").alias("description"), (F.col("residues") if keep_case else F.translate("residues", ".", "-")).alias("residues"))


def stockholm_notes(texts: DataFrame) -> DataFrame:
    """(msa_id, accession, description, classes, match): annotations of the first alignment of each Stockholm file.

    ``classes`` is the consensus line of residue classes, joined over blocks;
    ``match`` lists the columns where the first sequence has an upper-case
    letter or a hyphen.
    """
    first = F.substring_index(F.regexp_replace("value", "\r", ""), "\n//", 1)
    lines = texts.select(F.col("name").alias("msa_id"), F.posexplode(F.split(first, "\n")).alias("line", "text"))
    note = lambda tag: F.min(F.when(F.col("text").rlike(rf"^#=GF\s+{tag}\s"), F.trim(F.regexp_extract("text", rf"^#=GF\s+{tag}\s+(.*)$", 1))))
    part = F.when(F.col("text").rlike(r"^#=GC\s+seq_cons\s"), F.struct("line", F.regexp_extract("text", r"^#=GC\s+seq_cons\s+(\S+)", 1).alias("p")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]), "")
    notes = lines.groupBy("msa_id").agg(note("AC").alias("accession"), note("DE").alias("description"), joined.alias("classes"))
    own = stockholm_sequences(texts, keep_case=True).filter("seq_id = 0")
    letters = F.split("residues", "")
    match = F.filter(F.transform(letters, lambda x, i: F.when(x.rlike("^[A-Z-]$"), i + 1)), lambda x: x.isNotNull())
    return notes.join(own.select("msa_id", match.alias("match")), "msa_id", "left")


def alignments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sequences of either format, told by the first line."""
    texts = read_texts(spark, paths)
    is_stockholm = F.col("value").startswith("# STOCKHOLM")
    return stockholm_sequences(texts.filter(is_stockholm)).unionByName(fasta_sequences(texts.filter(~is_stockholm)))


def cells(sequences: DataFrame) -> DataFrame:
    """(msa_id, seq_id, pos, code) of sequences."""
    at = F.posexplode(F.split("residues", ""))
    return sequences.select("msa_id", F.col("seq_id").cast("long").alias("seq_id"), at.alias("at", "letter")).select(
        "msa_id", "seq_id", (F.col("at") + 1).alias("pos"), encode(F.col("letter")).alias("code")
    )


def fasta_text(sequences: DataFrame) -> DataFrame:
    """(msa_id, value): aligned FASTA of each alignment."""
    entry = F.concat(F.lit(">"), F.coalesce("description", F.lit("")), F.lit("\n"), "residues", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("seq_id", entry.alias("e"))))
    return sequences.groupBy("msa_id").agg(F.array_join(F.transform(rows, lambda r: r["e"]), "").alias("value"))


# ------------------------------------------------------------- profile text

SCALE = 10000
PROFILE = "name string, description string, len int, n_seqs int, eff_nos double, pos int, aa string, trg array<double>, trn array<double>, mid array<double>, state string"


def profile_text(rows: DataFrame) -> DataFrame:
    """(name, value): condensed profile text, all probabilities rounded to integers of 1 / SCALE."""
    def ints(c: str):
        return F.array_join(F.transform(c, lambda x: F.rint(x * SCALE).cast("long").cast("string")), " ")

    line = F.concat(
        F.col("pos").cast("string"), F.lit(" "), "aa", F.lit(" "), ints("trg"), F.lit("\n  "), ints("trn"), F.lit("\n  "), ints("mid"),
        F.when(F.col("state").isNotNull(), F.concat(F.lit("\n  SS:"), "state")).otherwise(""), F.lit("\n"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda r: r["l"]), "")
    head = F.concat(
        F.lit("PROFILE v2.0\nDESC: "), F.coalesce("description", F.lit("")), F.lit("\nFILE: "), "name", F.lit("\nLEN: "), F.col("len").cast("string"),
        F.lit("\nNOS: "), F.col("n_seqs").cast("string"), F.lit("\nEFFNOS: "), F.format_string("%.1f", "eff_nos"), F.lit(f"\nSCALE: {SCALE}\n"),
    )
    keyed = rows.withColumn("head", head).groupBy("name", "head").agg(body.alias("body"))
    return keyed.select("name", F.concat("head", "body", F.lit("*\n")).alias("value"))


def profiles(texts: DataFrame) -> DataFrame:
    """Profile positions of (name, value) texts, which may hold several profiles, each closed by a line with an asterisk."""

    def parsed(batches):
        names = [x.split()[0] for x in PROFILE.split(", ")]
        for batch in batches:
            rows = []
            for value in batch["value"]:
                for text in (value or "").replace("\r", "").split("\n*"):
                    head, body, last = {}, [], None
                    for line in text.split("\n"):
                        if not line.strip() or line.startswith("PROFILE"):
                            continue
                        key, _, rest = line.strip().partition(":")
                        if not line.startswith(" ") and key in ("DESC", "FILE", "LEN", "NOS", "EFFNOS", "SCALE"):
                            head[key] = rest.strip()
                        elif not line.startswith(" "):
                            part = line.split()
                            last = [int(part[0]), part[1], [float(x) for x in part[2:]]]
                            body.append(last)
                        elif key == "SS":
                            last.append(rest.strip())
                        else:
                            last.append([float(x) for x in line.split()])
                    scale = float(head.get("SCALE", SCALE))
                    for pos, aa, trg, trn, mid, *state in body:
                        rows.append((
                            head.get("FILE"), head.get("DESC") or None, int(head["LEN"]), int(head["NOS"]), float(head["EFFNOS"]), pos, aa,
                            *([x / scale for x in v] for v in (trg, trn, mid)), state[0] if state else None,
                        ))
            yield pd.DataFrame(rows, columns=names)

    return texts.select("value").mapInPandas(parsed, PROFILE)


def write_database(rows: DataFrame, path: str) -> None:
    """Profiles as columns, longest first within each file, so that readers skip fields they don't need."""
    rows.repartition("name").sortWithinPartitions(F.desc("len"), "name", "pos").write.mode("overwrite").parquet(path)


def full_profile_text(rows: DataFrame) -> DataFrame:
    """(name, value): profiles with every field, a line each: targets, observed weights, transitions, observations and information of each position."""
    part = lambda c, form: F.array_join(F.transform(c, lambda x: F.format_string(form, x)), " ")
    line = F.concat(
        F.col("pos").cast("string"), F.lit(" "), "aa", F.lit("\n  TRG: "), part("trg", "%.6f"), F.lit("\n  OBS: "), part("obs", "%.6f"), F.lit("\n  TRN: "), part("trn", "%.6f"),
        F.lit("\n  MID: "), part("mid", "%.6f"), F.lit("\n  INF: "), F.format_string("%.6f", "information"), F.lit("\n"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda r: r["l"]), "")
    head = F.concat(F.lit("NAME: "), "name", F.lit("\nLEN: "), F.col("len").cast("string"), F.lit("\nNOS: "), F.col("n_seqs").cast("string"), F.lit("\nEFFNOS: "), F.format_string("%.4f", "eff_nos"), F.lit("\n"))
    return rows.groupBy("name", head.alias("head")).agg(body.alias("body")).select("name", F.concat("head", "body", F.lit("*\n")).alias("value"))


def database_text(rows: DataFrame) -> DataFrame:
    """(len, name, value): a database's header, then its profiles in condensed text, longest first.

    The rows are in order; the header's length stands before all others.
    """
    texts = profile_text(rows).join(rows.select("name", "len").distinct(), "name")
    sums = texts.agg(F.count("*").alias("n"), F.sum("len").alias("s"))
    head = sums.select(
        F.lit(2**31 - 1).alias("len"), F.lit("").alias("name"), F.concat(F.lit("DATABASE v2.0\nPROFS: "), F.col("n").cast("string"), F.lit("\nSIZE: "), F.coalesce("s", F.lit(0)).cast("string"), F.lit("\n")).alias("value")
    )
    return head.unionByName(texts.select("len", "name", "value")).orderBy(F.desc("len"), "name")


def text_header(texts: DataFrame) -> DataFrame:
    """(name, n_profiles, n_positions) as the headers of database texts state them."""
    number = lambda key: F.regexp_extract("value", rf"(?m)^{key}:\s*(\d+)", 1).cast("long")
    return texts.filter(F.col("value").startswith("DATABASE")).select("name", number("PROFS").alias("n_profiles"), number("SIZE").alias("n_positions"))


def open_database(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a database: the columnar form under ``path.parquet`` if there is one, else ``path`` as columns, else as text."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    for where in (f"{path}.parquet", path):
        try:
            return spark.read.parquet(where)
        except (PySparkException, Py4JJavaError):  # not there, or not columns
            continue
    return profiles(read_texts(spark, path).withColumn("value", F.regexp_replace("value", r"^DATABASE[^\n]*\n(?:PROFS|SIZE):[^\n]*\n(?:PROFS|SIZE):[^\n]*\n", "")))


def open_databases(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Profiles of several databases with their ``db``, each name once, largest first; and the names that couldn't be read."""
    found, bad = [], []
    for path in sorted(set(paths)):
        try:
            rows = open_database(spark, path)
            found.append((rows.count(), path, rows))
        except Exception:  # noqa: BLE001 - whatever makes a database unreadable, the others are searched
            bad.append(path)
    if not found:
        raise ValueError(f"no database could be read: {', '.join(bad)}")
    out = None
    for _, path, rows in sorted(found, key=lambda x: (-x[0], x[1])):
        rows = rows.withColumn("db", F.lit(path))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, bad


def database_header(rows: DataFrame) -> DataFrame:
    """Number of profiles and of positions."""
    return rows.agg(F.count_distinct("name").alias("n_profiles"), F.count("*").alias("n_positions"))


def chunked(rows: DataFrame, key: str, size: str, most_size: int, most_rows: int) -> DataFrame:
    """Rows (one for each profile) with a ``chunk`` of bounded total size and number, longest first; rows larger than a chunk are left out.

    Chunks are numbered by the size of all rows before, and split by number.
    """
    from pyspark.sql import Window

    kept = rows.filter(F.col(size) <= most_size)
    order = Window.orderBy(F.desc(size), key)  # a row for each profile of a database
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = kept.withColumn("part", F.floor(before / most_size))
    turn = F.floor((F.row_number().over(Window.partitionBy("part").orderBy(F.desc(size), key)) - 1) / most_rows)
    own = own.withColumn("turn", turn)
    return own.withColumn("chunk", F.dense_rank().over(Window.orderBy("part", "turn")) - 1).drop("part", "turn")


def described(text, most: int = 1024):
    """A description on one line: leading white space off, runs of blanks one blank; cut to ``most`` characters, of which the last three are dots if it has as many."""
    line = F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\r]+", ""), r"[ \t]+", " ")
    return F.when((F.length(line) >= most) & (F.lit(most) > 3), F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(F.substring(line, 1, most))


# -------------------------------------------------------------------- others


def predictions(texts: DataFrame) -> DataFrame:
    """(name, pos, aa, state, pc, pe, ph) of secondary-structure predictions: index, residue, state and three probabilities a line."""
    rows = texts.select("name", F.explode(F.split("value", "\n")).alias("line"))
    pattern = r"^\s*(\d+)\s+([A-Z])\s+([CEH])\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return rows.filter(F.col("line").rlike(pattern)).select(
        "name", part(1).cast("int").alias("pos"), part(2).alias("aa"), part(3).alias("state"), *(part(i).cast("double").alias(c) for i, c in ((4, "pc"), (5, "pe"), (6, "ph")))
    )


def options(text: str, section: str = "OPTIONS", defaults: dict | None = None) -> dict[str, str]:
    """Key-value options of a section; comments start with #."""
    found = configparser.ConfigParser(strict=False, inline_comment_prefixes=("#",), comment_prefixes=("#",))
    found.optionxform = str
    found.read_string(text)
    return {**(defaults or {}), **(dict(found[section]) if found.has_section(section) else {})}


def json_results(found: DataFrame) -> DataFrame:
    """(query_id, value): one JSON document a query, hits in order of rank, valid at any number of them."""
    record = F.struct(*(c for c in found.columns if c not in ("query_id", "rank")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", record.alias("r")))), lambda x: x["r"])
    return found.groupBy("query_id").agg(rows.alias("search_hits")).select("query_id", F.to_json(F.struct("query_id", "search_hits")).alias("value"))


def hit_record():
    """A hit as a nested record: lengths, effective numbers, and the alignment with its statistics."""
    c = F.col
    alignment = F.struct(
        "score", "bit_score", "evalue", "pvalue", c("n_ident").alias("n_identities"), c("positives").alias("n_positives"), "n_gaps", c("aln_len").alias("aln_length"),
        c("q_from").alias("query_from"), c("q_to").alias("query_to"), c("t_from").alias("target_from"), c("t_to").alias("target_to"), c("q_aln").alias("query_aln"), c("t_aln").alias("target_aln"), "middle",
        c("k").alias("computed_K_ungapped"), c("lambda").alias("computed_lambda_ungapped"), sig.gapped_k(c("k")).alias("estimated_K_gapped"), sig.gapped_lambda(c("lambda")).alias("estimated_lambda_gapped"),
        "entropy", c("expected").alias("expected_score"), "min_score", "max_score",
    )
    return F.struct("target_id", c("query_len").alias("query_length"), c("query_eno").alias("query_eno"), c("target_len").alias("target_length"), c("target_eno").alias("target_eno"), alignment.alias("alignment"))


def result_documents(found: DataFrame, n_profiles: int, n_positions: int, n_hits: int = 700, n_alignments: int = 700, program: str = "seqlake", version: str = "1") -> DataFrame:
    """(query_id, value): one JSON document a query: program, query, database, message, search_summary, search_hits and search_statistics.

    The summary has the first ``n_hits`` by rank, the hits' alignments the
    first ``n_alignments``; hits without an aligned position are left out.
    """
    c = F.col
    rows = found.filter("aln_len >= 1")
    summary = F.when(c("rank") <= n_hits, F.struct("rank", F.struct("target_id", "score", "evalue").alias("r")))
    hit = F.when(c("rank") <= n_alignments, F.struct("rank", hit_record().alias("r")))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda v: v["r"])
    grouped = rows.groupBy("query_id", "query_len").agg(ordered(summary).alias("search_summary"), ordered(hit).alias("search_hits"), F.first("space").alias("space"))
    statistics = F.struct(
        F.lit(sig.LAMBDA_REF).alias("reference_lambda_ungapped"), F.lit(sig.K_REF).alias("reference_K_ungapped"), F.lit(sig.LAMBDA_GAPPED).alias("reference_lambda_gapped"),
        F.lit(sig.K_GAPPED).alias("reference_K_gapped"), c("query_len").alias("query_length"), F.lit(n_positions).alias("database_size"), c("space").alias("search_space"),
    )
    document = F.struct(
        F.lit(program).alias("program"), F.lit(version).alias("version"), F.struct("query_id", c("query_len").alias("length")).alias("query"),
        F.struct(F.lit(n_profiles).alias("number_of_profiles"), F.lit(n_positions).alias("number_of_positions")).alias("database"),
        F.when(F.size("search_summary") == 0, "No hits found").otherwise("").alias("message"), "search_summary", "search_hits", statistics.alias("search_statistics"),
    )
    return grouped.select("query_id", F.to_json(document).alias("value"))


def alignment_block(q: str, middle: str, t: str, q_from: int, t_from: int, width: int = 60) -> str:
    """An alignment as text: blocks of three lines with the positions of the residues at either end."""
    out, at_q, at_t = [], q_from, t_from
    for i in range(0, len(q), width):
        a, m, b = q[i : i + width], middle[i : i + width], t[i : i + width]
        n, k = len(a.replace("-", "")), len(b.replace("-", ""))
        out.append(f"Query: {at_q:>6} {a} {at_q + n - 1 if n else at_q:>6}\n{'':14}{m}\nSbjct: {at_t:>6} {b} {at_t + k - 1 if k else at_t:>6}\n")
        at_q, at_t = at_q + n, at_t + k
    return "\n".join(out)


def plain_documents(found: DataFrame, n_profiles: int, n_positions: int, n_hits: int = 700, n_alignments: int = 700, width: int = 60, program: str = "seqlake") -> DataFrame:
    """(query_id, value): one text a query: database, summary lines, and a block for each alignment."""
    fields = "rank target_id score bit_score evalue pvalue n_ident positives n_gaps aln_len q_from t_from q_aln middle t_aln query_len target_len".split()

    def made(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        lines = [f"{program}\n\n Query ({group['query_len'].iloc[0]} positions): {key[0]}\n Database: {n_profiles} profiles, {n_positions} total positions\n"]
        lines += [f"{r.target_id:>10} {r.score:10.1f} {r.evalue:10.2g}" for r in group[group["rank"] <= n_hits].itertuples()]
        for r in group[group["rank"] <= n_alignments].itertuples():
            share = lambda x: f"{x}/{r.aln_len} ({100 * x // r.aln_len}%)"
            lines.append(
                f"\n{r.rank}.\n>{r.target_id}\n  Length/Target: Query length = {r.query_len}, Target length = {r.target_len}\n\n Score = {r.score:.2f} ({r.bit_score:.1f} bits),  Expect = {r.evalue:.2g}, P-value = {r.pvalue:.2g}\n"
                f" Identities = {share(r.n_ident)}, Positives = {share(r.positives)}, Gaps = {share(r.n_gaps)}\n\n" + alignment_block(r.q_aln, r.middle, r.t_aln, r.q_from, r.t_from, width)
            )
        return pd.DataFrame({"query_id": [key[0]], "value": ["\n".join(lines) + "\n"]})

    return found.filter("aln_len >= 1").select("query_id", *fields).groupBy("query_id").applyInPandas(made, "query_id long, value string")


def write_documents(documents: DataFrame, path: str, ending: str = "json") -> None:
    """A folder for each query, named ``<query>__<number>.<ending>`` by its place among the ids, with its document as text."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("query_id")) - 1  # a row for each query
    named = documents.withColumn("file", F.concat(F.col("query_id").cast("string"), F.lit("__"), number.cast("string"), F.lit(f".{ending}")))
    named.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def probability_text(pairs: DataFrame) -> DataFrame:
    """One row (value): pair probabilities (bin_a, bin_b, p) as a lower triangle of lines, absent pairs as 0."""
    rows = pairs.agg(F.array_sort(F.collect_list(F.struct("bin_a", "bin_b", "p"))).alias("r"))  # at most 903 pairs
    number = lambda a, b: F.try_element_at(F.transform(F.filter("r", lambda x: (x["bin_a"] == a) & (x["bin_b"] == b)), lambda x: x["p"]), F.lit(1))
    line = lambda a: F.array_join(F.transform(F.sequence(F.lit(0), a), lambda b: F.format_string("%.6g", F.coalesce(number(a, b), F.lit(0.0)))), " ")
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(41)), line), "\n").alias("value"))


def plain_results(found: DataFrame, width: int = 60) -> DataFrame:
    """(query_id, value): one text a query."""
    line = F.format_string("%d. target %d  score %.2f  E-value %.3g  identities %d/%d", "rank", "target_id", "score", "evalue", "n_ident", "aln_len")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    return found.groupBy("query_id").agg(F.concat(F.format_string("Query %d\n", F.col("query_id")), F.array_join(rows, "\n"), F.lit("\n")).alias("value"))


# ------------------------------------------------------------------- reports

REPORT = "query_id string, round int, target string, score double, evalue double, q_from int, q_aln string, t_from int, t_aln string"


def search_reports(texts: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """Hits of iterated search reports (blocks of Query / Sbjct lines under each > header), up to an E-value.

    Rounds are counted by their headings; use ``last_round`` for the final one.
    """
    import re

    names = [x.split()[0] for x in REPORT.split(", ")]
    score = re.compile(r"Score\s*=\s*([\d.]+).*?Expect(?:\(\d+\))?\s*=\s*([\d.eE+-]+)")
    line = re.compile(r"^(Query|Sbjct):?\s+(\d+)\s+(\S+)\s+(\d+)")

    def parsed(batches):
        for batch in batches:
            rows = []
            for name, value in zip(batch["name"], batch["value"]):
                turn, target, hit = 1, None, None
                for text in (value or "").splitlines():
                    if text.startswith("Results from round"):
                        turn = int(text.split()[-1])
                    elif text.startswith(">"):
                        target = text[1:].strip()
                    elif m := score.search(text):
                        e = m[2]
                        hit = [name, turn, target, float(m[1]), float("1" + e if e.startswith("e") else e), None, "", None, ""]
                        rows.append(hit)
                    elif hit and (m := line.match(text)):
                        at = 5 if m[1] == "Query" else 7
                        hit[at] = hit[at] or int(m[2])
                        hit[at + 1] += m[3]
            yield pd.DataFrame([r for r in rows if r[4] <= cutoff], columns=names)

    return texts.select("name", "value").mapInPandas(parsed, REPORT)


def last_round(hits: DataFrame) -> DataFrame:
    """Hits of each query's last round."""
    last = hits.groupBy("query_id").agg(F.max("round").alias("round"))
    return hits.join(last, ["query_id", "round"], "left_semi")


def json_hits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Hits of JSON results, one row each."""
    docs = spark.read.json(paths)
    return docs.select("query_id", F.explode("search_hits").alias("h")).select("query_id", "h.*")


def covariance_text(rows: DataFrame) -> DataFrame:
    """(msa_id, value): a line for each pair of columns: i, j and the values, three digits."""
    line = F.concat_ws(" ", "i", "j", F.array_join(F.transform("values", lambda v: F.format_string("%.3g", v)), " "))
    made = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", line.alias("l")))), lambda r: r["l"])
    return rows.groupBy("msa_id").agg(F.array_join(made, "\n").alias("value"))
