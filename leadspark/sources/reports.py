"""Line-oriented reports: documents to ordered lines, lines to records.

Both layouts are gaps-and-islands: running counts of header lines number the sections and records of
a document, ordered conditions give every line a kind, and a grouped fold picks the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.columns import builder_name, first_date, type_prefix, whole_dollars

# What the lines of the two report layouts look like.
SUB_TYPE = r"(?i)SUB\s+TYPE:\s*(.+)"
APPLICANT, CONTRACTOR = r"(?i)^APPLICANT\s*(.*)", r"(?i)^CONTRACTOR\s*(.*)"
ISSUE_HEADER = r"(?i)^issue\s+date\s+(\d{4}/\d{2}/\d{2})$"
CHROME = r"(?i)^(folder\s*number|work\s*proposed|status|issue\s*date|constr|sub\s*total|grand\s*total|building\s*permit|city\s*of\s*richmond|filters|issued\s*from)"
FOLDER_START, FOLDER = r"^\d{2}\s+\d{6}", r"\d{2}\s+\d{6}\s+\d{3}\s+\d{2}\s+[A-Z]\d+"
SUFFIX = r"^[A-Z]\d+$"
NAME_HEADER, NAME_DATA = r"(?i)^folder\s+name\s*$", r"(?i)^folder\s+name\s+(.+)"
DATE_LINE = r"^(\d{4}/\d{2}/\d{2})(\s+\d+)?$"
MONEY, LONE_COUNT = r"^\$[\d,]+\.?\d*$", r"^\d+$"
HEADER = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},\s+\d{4}\s+([A-Z]{2,3}\d{5,7})"
HEADER_DATE = r"^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},\s+\d{4})"
PERMIT_NUMBER, DECIMAL = r"[A-Z]{2,3}\d{5,7}", r"[\d,]+\.\d{2}"
TYPE_LINE, PURPOSE_LINE, CIVIC_LINE = r"(?i)^\s*Type\s+(.+)", r"(?i)^\s*Purpose\s+(.+)", r"(?i)Civic\s+Address:\s*(.+)"


def document_lines(docs: DataFrame, text: str = "value", doc: str = "doc_id", trim: bool = True) -> DataFrame:
    """doc_id, line_no, line; flow layout trims lines and drops blank ones, column layout keeps indentation."""
    lines = docs.select(doc, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))
    if trim:
        return lines.withColumn("line", F.btrim("line", F.lit(" \t\r\f\n"))).where("line <> ''")
    return lines.where("trim(line) <> ''")


def _part(line: Column, pattern: str, group: int = 1) -> Column:
    return F.trim(F.regexp_extract(line, pattern, group))


def flow_records(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Records of flow-layout reports, each with the contact block of its section.

    Sections carry a sub-type; a record starts at a folder number; fields are told by their form;
    contact blocks follow all records and belong to sections by ordinal. Columns: doc_id, rec,
    section, sub_type, folder_number, work_proposed, status, address, issue_date, value, applicant, contractor.
    """
    order = Window.partitionBy(doc).orderBy("line_no")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("line")
    head = F.when(line.rlike(SUB_TYPE), "section").when(line.rlike(APPLICANT), "applicant").when(line.rlike(CONTRACTOR), "contractor")
    rows = lines.withColumn("head", head)
    mark = F.when(F.col("head") == "section", "permits").when(F.col("head") == "applicant", "contacts")
    rows = rows.withColumn("phase", F.coalesce(F.last(mark, True).over(so_far), F.lit("permits")))
    rows = rows.withColumns(
        {
            "section": F.sum(F.when(F.col("head") == "section", 1).otherwise(0)).over(so_far),
            "block": F.sum(F.when(F.col("head") == "applicant", 1).otherwise(0)).over(so_far),
            "sub_type": F.last(F.when(F.col("head") == "section", _part(line, SUB_TYPE)), True).over(so_far),
        }
    )
    body = rows.where("phase = 'permits' and (head is null or head = 'section')")
    plain = F.col("head").isNull()
    kind = (
        F.when(~plain, "section")
        .when(line.rlike(ISSUE_HEADER), "issue")
        .when(line.rlike(CHROME), "chrome")
        .when(line.rlike(FOLDER_START), "folder")
        .when(line.rlike(SUFFIX), "suffix")
        .when(line.rlike(NAME_HEADER), "name")
        .when(line.rlike(NAME_DATA), "named")
        .when(line.rlike(DATE_LINE), "date")
        .when(line.rlike(MONEY), "money")
        .when(line.rlike(LONE_COUNT), "count")
        .otherwise("text")
    )
    # The start of contacts closes a record too: later lines of the phase come after a new section header.
    body = body.withColumn("kind", kind).withColumn("rec", F.sum(F.when(F.col("kind") == "folder", 1).otherwise(0)).over(so_far))
    opened = F.last(F.when(F.col("kind").isin("folder", "section"), F.col("kind")), True).over(so_far)
    body = body.withColumn("open", opened).where("open = 'folder'").drop("open")
    per = Window.partitionBy(doc, "rec").orderBy("line_no")
    earlier = per.rowsBetween(Window.unboundedPreceding, -1)
    texts = F.coalesce(F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(earlier), F.lit(0))
    body = body.withColumn("kind", F.when((F.col("kind") == "suffix") & (texts > 0), "text").otherwise(F.col("kind")))
    # A bare FOLDER NAME stays pending over skipped lines and claims the next one of another kind.
    asks = F.last(F.when(~F.col("kind").isin("issue", "chrome", "suffix"), F.col("kind")), True).over(earlier)
    claimed = (asks == "name") & ~F.col("kind").isin("issue", "chrome", "suffix", "folder", "section")
    body = body.withColumn("kind", F.when(F.coalesce(claimed, F.lit(False)), "claimed").otherwise(F.col("kind")))
    found = F.when(F.col("kind") == "folder", F.coalesce(F.nullif(F.regexp_extract("line", FOLDER, 0), F.lit("")), line)).when(F.col("kind") == "suffix", line)
    value = whole_dollars("line")
    address = F.when(F.col("kind") == "claimed", line).when(F.col("kind") == "named", _part(line, NAME_DATA))
    dated = F.when(F.col("kind") == "issue", _part(line, ISSUE_HEADER)).when(F.col("kind") == "date", _part(line, DATE_LINE))
    slots = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("line_no", "line"))))
    pick = lambda n: F.coalesce(F.try_element_at(slots, F.lit(n))["line"], F.lit(""))
    records = body.groupBy(doc, "rec").agg(
        F.min("section").alias("section"),
        F.min_by("sub_type", "line_no").alias("sub_type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(found.isNotNull(), F.struct("line_no", found.alias("t"))))), lambda x: x["t"]), " ").alias("folder_number"),
        pick(1).alias("work_proposed"),
        pick(2).alias("status"),
        F.coalesce(F.max_by(address, F.when(address.isNotNull(), F.col("line_no"))), pick(3)).alias("address"),
        first_date(F.max_by(dated, F.when(dated.isNotNull(), F.col("line_no"))), ["yyyy/MM/dd"]).alias("issue_date"),
        F.coalesce(F.min_by(value, F.when((F.col("kind") == "money") & (value > 0), F.col("line_no"))), F.lit(0).cast("bigint")).alias("value"),
    )
    return records.join(contact_blocks(rows, doc), [doc, "section"], "left").select(doc, "rec", "section", "sub_type", "folder_number", "work_proposed", "status", "address", "issue_date", "value", *[F.coalesce(c, F.lit("")).alias(c) for c in ("applicant", "contractor")])


def contact_blocks(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Contact blocks by ordinal: doc_id, section, applicant, contractor; values inline or on the next line."""
    order = Window.partitionBy(doc, "block").orderBy("line_no")
    inline = lambda pattern: F.nullif(_part(F.col("line"), pattern), F.lit(""))
    phase = rows.where("phase = 'contacts' and (head is null or head <> 'section')")
    phase = phase.withColumn("given", F.when(F.col("head") == "applicant", inline(APPLICANT)).when(F.col("head") == "contractor", inline(CONTRACTOR)))
    asks = F.last(F.when(F.col("head").isNotNull(), F.struct("head", F.col("given").isNotNull().alias("done"), "line_no")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    phase = phase.withColumn("asks", F.when(F.col("head").isNull(), asks))
    first = (F.col("asks.head").isNotNull()) & ~F.col("asks.done") & (F.row_number().over(Window.partitionBy(doc, "block", "asks.line_no").orderBy("line_no")) == 1)
    phase = phase.withColumn("first", F.coalesce(first, F.lit(False)))
    value = lambda who: F.when(F.col("head") == who, F.col("given")).when(F.col("first") & (F.col("asks.head") == who), F.col("line"))
    last = lambda who: F.max_by(value(who), F.when(value(who).isNotNull(), F.col("line_no")))
    return phase.groupBy(doc, F.col("block").alias("section")).agg(last("applicant").alias("applicant"), last("contractor").alias("contractor"))


def column_records(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Records of column-layout reports: a dated header line, then indented labelled lines.

    The last decimal of the header is the value, the last address that is not empty wins.
    """
    so_far = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line, trimmed = F.col("line"), F.trim(F.col("line"))
    rows = lines.withColumn("is_head", line.rlike(HEADER)).withColumn("rec", F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(so_far))
    rows = rows.where("rec > 0").where(F.col("is_head") | line.rlike(r"^[ \t]"))
    kind = F.when(F.col("is_head"), "head").when(trimmed.rlike(TYPE_LINE), "type").when(trimmed.rlike(PURPOSE_LINE), "purpose").when(trimmed.rlike(CIVIC_LINE), "civic")
    rows = rows.withColumn("kind", kind)
    last = lambda name, value: F.coalesce(F.max_by(value, F.when((F.col("kind") == name) & (value != ""), F.col("line_no"))), F.lit(""))
    out = rows.groupBy(doc, "rec").agg(
        F.max(F.when(F.col("is_head"), line)).alias("head"),
        last("type", _part(trimmed, TYPE_LINE)).alias("type_raw"),
        last("purpose", _part(trimmed, PURPOSE_LINE)).alias("purpose"),
        last("civic", _part(trimmed, CIVIC_LINE)).alias("civic_address"),
    )
    number = F.regexp_extract("head", PERMIT_NUMBER, 0)
    value = whole_dollars(F.try_element_at(F.regexp_extract_all("head", F.lit(DECIMAL), F.lit(0)), F.lit(-1)))
    day = first_date(F.regexp_replace(F.regexp_extract("head", HEADER_DATE, 1), r"\s+", " "), ["MMM d, yyyy"])
    return out.select(doc, "rec", number.alias("permit_number"), builder_name("head", number).alias("builder"), day.alias("issue_date"), value.alias("value"), "type_raw", type_prefix("type_raw").alias("type_prefix"), "purpose", "civic_address")
