"""Bills of the grouped layout: one file, many accounts. Line state runs through the whole file, a run of lines at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators import runs
from aquabill.operators.route import GROUPED
from aquabill.schema import BILL
from aquabill.sources.files import stamp

# Line patterns of the grouped layout.
NUMBER, MONTH, DUE = r"N[º°Oo]?\s*FATURA:\s*(\d+)", r"M[ÊE]S/ANO\s*REF:?\s*([\d/]+)", r"VENCIMENTO:\s*([\d/]+)"
TRIGGER, HEADING, NAME_LINE = r"NOME.*?DO.*?[OÓ]RG[AÃ]O.*?AGRUPADOR", r"C[OÓ]D.*?[OÓ]RG", r"^(.*?)\s+(\d{3,})\s+(\d{3,})\s*$"
START, STOPS = r"CONTA.*?DV.*?NOME.*?CLIENTE", ["TOTAL", "INFORMAÇÕES", "RETENÇÕES", "FATURADO"]
ACCOUNT, NUMERIC = r"^(\d+\s\d)", r"^[\d.,]+$"
_EXACT, _ANY = "(?udU)", "(?iudU)"


def split_lines(docs: DataFrame, size: int = runs.LINES) -> DataFrame:
    """docs with line_no, line and run in place of content."""
    return runs.split_lines(docs, size)


def forward_fill(value: Column, frame) -> Column:
    """The last non-null value up to and including the row."""
    return F.last(value, ignorenulls=True).over(frame)


def in_state(event: Column, frame) -> Column:
    """Whether the last event (1 starts, 0 ends, null is none) was a start."""
    return F.coalesce(forward_fill(event, frame) == 1, F.lit(False))


def _fits(pattern: str, word: str) -> Column:
    """Whether the line in capitals fits a pattern, every match of which holds word; most lines do not even hold that."""
    return F.contains("u", F.lit(word)) & F.col("u").rlike(_EXACT + pattern)


def _value(pattern: str, word: str) -> Column:
    return F.when(F.contains("u", F.lit(word)) & F.col("line").rlike(_ANY + pattern), F.regexp_extract("line", _ANY + pattern, 1))


#: Header values: pattern, and a part of each match in capitals.
HEADER = {"number": (NUMBER, "FATURA:"), "month": (MONTH, "REF"), "due": (DUE, "MENTO:")}


def signs(lines: DataFrame) -> DataFrame:
    """lines with what each says by itself."""
    out = lines.withColumn("s", T.strip(F.col("line"))).withColumn("u", F.upper("s")).select(
        *lines.columns, "s", _fits(TRIGGER, "AGRUPADOR").alias("trigger"), ((F.col("s") == "") | _fits(HEADING, "RG")).alias("heading"),
        _fits(START, "CLIENTE").alias("start"), F.greatest(*[F.contains("u", F.lit(x)) for x in STOPS]).alias("stop"), *[_value(*p).alias(n) for n, p in HEADER.items()],
    )
    return out.withColumn("ends", F.col("s").rlike(_EXACT + NAME_LINE) & ~F.col("trigger") & ~F.col("heading"))


def marked(told: DataFrame) -> DataFrame:
    """signs() with how the run's own lines before it leave the capture (null: as it was entered)."""
    out, own = told.withColumn("turn", F.when(F.col("trigger"), 1).when(F.col("ends"), 0)), runs.within()
    return out.select("*", runs.latest(F.col("turn"), -1).alias("held"), F.sum(F.col("trigger").cast("int")).over(own).alias("captures"), F.row_number().over(own).alias("place"))


def _event(capturing: Column) -> Column:
    """Whether a line starts (1) or ends (0) the table; lines of a capture are not seen by it."""
    return F.when(F.col("trigger") | (capturing & F.col("heading")), None).when(F.col("start"), 1).when(F.col("stop"), 0)


def entries(lines: DataFrame) -> DataFrame:
    """(path, run, in): how each run of marked lines is entered, from the transitions of the runs before it."""
    ways = [F.coalesce(F.col("held"), F.lit(c)) == 1 for c in (0, 1)]
    per_way = lambda name, f: [f(w).alias(f"{name}{c}") for c, w in enumerate(ways)]
    runs_of = lines.groupBy(*runs.RUN).agg(
        F.count("*").alias("n"), F.max("captures").alias("captures"), runs.ending(F.col("turn")).alias("turn"), *per_way("event", lambda w: runs.ending(_event(w))),
        *per_way("closed", lambda w: F.max(F.when(w & F.col("ends"), F.col("captures")))), *[runs.ending(F.col(c)).alias(c) for c in HEADER],
    )
    came = runs_of.select("*", runs.entered(F.col("turn"), F.lit(0)).alias("turn_in"), runs.counted(F.col("captures")).alias("captures_in"), runs.counted(F.col("n")).alias("lines_in"))
    true = lambda name: F.when(F.col("turn_in") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    came = came.withColumns({"event": true("event"), "closed": true("closed") + F.col("captures_in")})
    said = {"event": runs.entered(F.col("event"), F.lit(0)), "closed": runs.entered(F.col("closed")), **{c: runs.entered(F.col(c)) for c in HEADER}}
    return came.select(*runs.RUN, F.struct(F.col("turn_in").alias("turn"), F.col("captures_in").alias("captures"), F.col("lines_in").alias("lines"), *[v.alias(n) for n, v in said.items()]).alias("in"))


def with_state(lines: DataFrame, scratch: str | None = None) -> DataFrame:
    """lines with line_no counted over the file, the header values, the number of the last capture that ended and whether a line is a row of the table."""
    told = signs(lines)
    if scratch:  # the patterns are then tried once, for all that reads what the lines say
        told.drop("line").write.parquet(scratch)
        told = lines.sparkSession.read.schema(told.drop("line").schema).parquet(scratch)
    said = marked(told)
    out = said.join(entries(said), runs.RUN).withColumn("capturing", F.coalesce(F.col("held"), F.col("in.turn")) == 1)
    masked = F.col("trigger") | (F.col("capturing") & F.col("heading"))
    part = F.when(F.col("capturing") & ~F.col("trigger") & ~F.col("heading"), F.when(F.col("ends"), F.regexp_extract("s", _EXACT + NAME_LINE, 1)).otherwise(F.col("s")))
    out = out.withColumns({"event": _event(F.col("capturing")), "masked": masked, "part": part, "capture": F.col("captures") + F.col("in.captures"), "closed": F.col("capturing") & F.col("ends")})
    table = F.coalesce(runs.latest(F.col("event")), F.col("in.event")) == 1
    row = table & F.col("event").isNull() & ~F.col("masked") & F.col("s").rlike("(?U)" + ACCOUNT)
    filled = {"last_capture": F.coalesce(runs.latest(F.when(F.col("closed"), F.col("capture"))), F.col("in.closed")), **{c: F.coalesce(runs.latest(F.col(c)), F.col(f"in.{c}")) for c in HEADER}}
    line_no = (F.col("in.lines") + F.col("place") - 1).cast("int")
    kept = [c for c in lines.columns if c not in ("line_no", "run", "line")]
    return out.select(*kept, line_no.alias("line_no"), "s", "part", "capture", "closed", row.alias("is_row"), *[v.alias(n) for n, v in filled.items()])


def grouping_bodies(lines: DataFrame) -> DataFrame:
    """(path, last_capture, body: name, group, payer) of each capture that ended; its parts are put together once, those of others never."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "part")))
    of = lambda i: F.regexp_extract("s", _EXACT + NAME_LINE, i)
    ends = lines.where("closed").select("path", F.col("capture").alias("last_capture"), of(2).alias("group"), of(3).alias("payer"))
    made = lines.where("part is not null").select("path", F.col("capture").alias("last_capture"), "line_no", "part").join(ends, ["path", "last_capture"])
    made = made.groupBy("path", "last_capture").agg(parts.alias("parts"), F.first("group").alias("group"), F.first("payer").alias("payer"))
    name = F.array_join(F.transform("parts", lambda x: x["part"]), " ")
    return made.select("path", "last_capture", F.struct(name.alias("name"), "group", "payer").alias("body"))


def parsed(rows: DataFrame) -> DataFrame:
    """Account, name, address and numbers of table rows."""
    pieces = F.split("s", r"(?U)\s{2,}")
    numeric = F.transform(F.reverse("pieces"), lambda x: x.rlike("(?U)" + NUMERIC) & x.rlike(r"(?U)\d"))
    n = F.coalesce(F.nullif(F.array_position("numeric", F.lit(False)), F.lit(0)) - 1, F.size("numeric")).cast("int")
    out = rows.withColumn("pieces", pieces).withColumn("numeric", numeric).withColumn("n", n)
    out = out.withColumn("tail", F.expr("slice(pieces, size(pieces) - n + 1, n)")).withColumn("texts", F.expr("slice(pieces, 2, greatest(size(pieces) - n - 1, 0))"))
    money, whole = F.filter("tail", lambda x: F.contains(x, F.lit(","))), F.filter("tail", lambda x: ~F.contains(x, F.lit(",")))
    amount = lambda values, i: T.br_decimal(F.coalesce(F.get(values, i), F.lit("")))
    return out.select(
        "*", F.regexp_extract("s", "(?U)" + ACCOUNT, 1).alias("account"), F.coalesce(F.get("texts", F.lit(0)), F.lit("")).alias("name"),
        F.array_join(F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))), " ").alias("street"), amount(whole, 0).alias("m3"),
        amount(money, 0).alias("water"), amount(money, 1).alias("sewage"), amount(money, 2).alias("fee"),
    )


def extract(docs: DataFrame, size: int = runs.LINES, scratch: str | None = None) -> DataFrame:
    """BILL rows (and path, block_no = line number) of routed docs of the grouped layout, in runs of size lines.

    At scratch, if given, the lines are written with what they say, so that no text is looked at twice.
    """
    return extract_lines(split_lines(docs.where(F.col("EMPRESA") == GROUPED), size), scratch)


def extract_lines(read: DataFrame, scratch: str | None = None) -> DataFrame:
    """BILL rows (and path, block_no = line number) of the routed lines of files, as split_lines() or files.scan_lines() give them."""
    lines = with_state(read.where(F.col("EMPRESA") == GROUPED), scratch)
    rows = parsed(lines.where("is_row")).join(grouping_bodies(lines), ["path", "last_capture"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = {
        "CONCESSIONARIA": F.lit(GROUPED), "NUM_FATURA": text("number"), "MES_ANO_REF": text("month"), "VENCIMENTO": text("due"),
        "COD_ORGAO_AGRUPADOR": text("body.group"), "COD_ORGAO_PAGADOR": text("body.payer"), "NOME_ORGAO_AGRUPADOR": text("body.name"),
        "CONTA_DV": F.col("account"), "NUM_HIDROMETRO": F.lit(""), "NOME_CLIENTE": F.col("name"), "LOGRADOURO": F.col("street"),
        "CONSUMO_M3": F.col("m3"), "VALOR_AGUA": F.col("water"), "VALOR_ESGOTO": F.col("sewage"), "BASE_CALCULO": F.col("water") + F.col("sewage"),
        "VALOR_TAXAS_EXTRAS": F.col("fee"), "VALOR_TOTAL": F.col("water") + F.col("sewage") + F.col("fee"), "DATA_PROCESSAMENTO": stamp(),
        "ARQUIVO_ORIGEM": F.col("file_name"), "PASTA_ORIGEM": F.col("dir"), "EMPRESA": F.col("EMPRESA"),
    }
    return rows.select("path", F.col("line_no").alias("block_no"), *[made[f.name].cast(f.dataType).alias(f.name) for f in BILL.fields])
