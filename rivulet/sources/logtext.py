"""Change events from the text form of a row log: numbered lines become events, without any task reading the whole log.

Lines carry their number (line_no), so order never depends on partitions. What a line needs from lines before it (file,
position, database, event, section) is carried by blocks of lines.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.text import clauses, scalar, scalar_kind, squeezed
from rivulet.operators.ordered import Blocks, log_index

_HEADER = "^### (UPDATE|INSERT INTO|DELETE FROM) `?([^`.\\s]+)`?[.]`?([^`\\s]+)`?"
_ASSIGN = "^###   @([0-9]+)\\s*=\\s*(.*?)(?:\\s*/\\*.*)?$"
_USE = "(?i)^\\s*use\\s+`?([^`\\s;]+)`?"


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern; null if it does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def lines(spark, path: str) -> DataFrame:
    """(line_no, line) of the log text under a path; the number orders lines by the number in the file's name, then by its
    name and place in the file.

    A split of a file holds its lines in order, so a line's number is its split's place among all splits and its place
    inside the split; only the splits, a row each, are put into one order.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("n"))
    splits = rows.groupBy("file", "start").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    number = log_index(F.regexp_replace("file", "[.](txt|log)$", ""))
    before = F.sum("size").over(Window.orderBy(number, "file", "start").rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(placed, ["file", "start"]).select((F.col("before") + F.col("n") - F.col("first")).alias("line_no"), "line")


def _blocks(log: DataFrame | Blocks, width: int | None) -> Blocks:
    """The log's lines in blocks; such as are there (in the order of line_no) are used again."""
    return copy(log) if isinstance(log, Blocks) else Blocks(log, "line_no", (), width)


def row_events(log: DataFrame | Blocks, files: int = 1, columns: dict[int, str] | None = None, width: int | None = None) -> DataFrame:
    """One row for each changed row: event_no, op, database_name, table_name, line_no, file_index, log_pos, before and after
    (maps of column to decoded text). Columns are named by ordinal (columns), or UNKNOWN_COL{n-1}.
    """
    line = F.col("line")
    rows = _blocks(log, width)
    # what a line says by itself, before rows are dealt by blocks; patterns are tried where the line's beginning allows
    known = F.create_map(*(F.lit(x) for kv in (columns or {}).items() for x in kv)) if columns else F.create_map().cast("map<int,string>")
    own = rows.rows.withColumn("_cell", line.startswith("###   @") & line.rlike(_ASSIGN)).withColumn("_head", line.startswith("### ") & line.rlike(_HEADER))
    own = own.withColumn("_o", F.when(F.col("_cell"), F.regexp_extract(line, _ASSIGN, 1)).try_cast("int")).withColumn("_raw", F.when(F.col("_cell"), F.regexp_extract(line, _ASSIGN, 2)))
    own = own.withColumn("_kind", scalar_kind(F.col("_raw")))
    name = F.coalesce(F.try_element_at(known, F.col("_o")), F.concat(F.lit("UNKNOWN_COL"), (F.col("_o") - 1).cast("string")))
    cell = F.when(F.col("_cell"), F.struct(F.col("_o").alias("o"), name.alias("k"), scalar(F.col("_raw"), F.col("_kind")).alias("v")))
    part = lambda i: F.regexp_extract(line, _HEADER, i)
    head = F.when(F.col("_head"), F.struct(F.lower(F.split(part(1), " ")[0]).alias("op"), part(2).alias("database_name"), part(3).alias("table_name"), "line_no"))
    rows.rows = own.select(
        "line_no",
        "_block",
        cell.alias("cell"),
        head.alias("head"),
        F.when(line.startswith("# at "), _got(line, "^# at ([0-9]+)")).try_cast("long").alias("_at"),
        F.when(F.col("_head") | line.rlike("^### SET\\s*$"), "after").when(line.rlike("^### WHERE\\s*$"), "before").alias("_section"),
    )
    parts = rows.parts
    rows = rows.level(
        sums={"event_no": F.col("head").isNotNull().cast("int")},
        carries={"log_pos": F.col("_at"), "section": F.col("_section")},
        descents={"_file": F.col("_at")},
    ).done()
    of = F.struct("head.*", F.least("_file", F.lit(files - 1)).cast("long").alias("file_index"), "log_pos")
    image = lambda which: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == which, F.col("cell")))), lambda c: F.struct(c["k"], c["v"])))
    rows = rows.where("event_no > 0 and (head is not null or cell is not null)").select("event_no", "section", "cell", F.when(F.col("head").isNotNull(), of).alias("of"))
    rows = rows.repartition(parts, "event_no") if parts else rows
    out = rows.groupBy("event_no").agg(F.max("of").alias("of"), image("before").alias("before"), image("after").alias("after"))  # one `of` to an event
    return out.select("event_no", "of.*", "before", "after")


_DELIMITER = "(?i)^\\s*DELIMITER\\s+(\\S+)\\s*$"


def statements(log: DataFrame | Blocks, delimiter: str = ";", width: int | None = None) -> DataFrame:
    """(line_no, log_pos, current_database, sql) of each statement in the log text, however many lines it takes.

    A statement goes on to the line that ends with the delimiter outside of single quotes; DELIMITER lines change that, and
    a USE holds from its own line on. The log's own comments (# at, #date, ###) belong to none and take no part in the
    count of quotes, but a text that is open there keeps its lines. What the log's end cuts off is no statement. line_no is that of the statement's first
    line and log_pos the last position before it, which put statements and row events (row_events) into one order.
    """
    line = F.col("line")
    quotes = F.length(F.regexp_replace(line, "\\\\.|[^']", ""))
    comment = line.startswith("#") & line.rlike("^#( at [0-9]|[0-9]{6}|##)")
    rows = _blocks(log, width)
    rows.rows = rows.rows.withColumn("_q", F.when(comment, 0).otherwise(quotes)).withColumn("_set", _got(line, _DELIMITER))
    rows.level(
        sums={"_quotes": F.col("_q")},
        carries={"log_pos": F.when(line.startswith("# at "), _got(line, "^# at ([0-9]+)")).try_cast("long"), "_delimiter": F.col("_set"), "current_database": _got(line, _USE)},
    )
    ends_with = F.coalesce("_delimiter", F.lit(delimiter))
    inside = (F.col("_quotes") - F.col("_q")) % 2 == 1
    part = (inside | ~comment) & F.col("_set").isNull() & (F.trim(line) != "")
    whole = part & (F.col("_quotes") % 2 == 0) & F.endswith(F.rtrim(line), ends_with)
    rows.rows = rows.rows.withColumn("_part", part).withColumn("_whole", whole)
    found = rows.level(sums={"_ends": F.col("_whole").cast("int")}).done().where("_part")
    text = F.when(F.col("_whole"), F.left(F.rtrim(line), F.length(F.rtrim(line)) - F.length(ends_with))).otherwise(line)
    own = found.withColumn("_no", F.col("_ends") - F.col("_whole").cast("int"))
    lines_of = F.array_sort(F.collect_list(F.struct("line_no", text.alias("text"))))  # a statement's lines
    out = own.groupBy("_no").agg(F.min("line_no").alias("line_no"), F.min_by("log_pos", "line_no").alias("log_pos"), F.min_by("current_database", "line_no").alias("current_database"), lines_of.alias("l"), F.bool_or("_whole").alias("whole"))
    return out.where("whole").select("line_no", "log_pos", "current_database", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("sql"))


#: Fixed values of the statements' grammar: verbs of whole statements and of clauses with the action they stand for, kinds of
#: object, and words that may stand between a verb and its object.
WHOLE_VERBS = {"CREATE": "create", "DROP": "drop"}
CLAUSE_VERBS = {"ADD": "alter", "DROP": "drop", "MODIFY": "alter", "CHANGE": "alter"}
KINDS = {"DATABASE": "database", "TABLE": "table", "INDEX": "index"}
SKIPPED = ("UNIQUE", "IF", "NOT", "EXISTS")
#: A token: a backticked name, a parenthesis, a dot, or a run of other characters.
_TOKEN = "`[^`]*`|[().]|[^\\s`().,;]+"


def _tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(f"({_TOKEN})"), F.lit(1))


def _bare(token: Column) -> Column:
    """A name without its backticks."""
    return F.regexp_replace(F.coalesce(token, F.lit("")), "`", "")


def _word(tokens: Column, i: int) -> Column:
    return F.upper(F.coalesce(F.try_element_at(tokens, F.lit(i)), F.lit("")))


def _after(tokens: Column, n: Column | int) -> Column:
    """The tokens after the first n."""
    return F.slice(tokens, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.size(tokens))


def _rest(tokens: Column) -> Column:
    """tokens without the words at the front that only qualify."""
    from_ = F.filter(F.transform(tokens, lambda t, i: F.when(~F.upper(t).isin(*SKIPPED), i)), lambda i: i.isNotNull())
    return _after(tokens, F.coalesce(F.try_element_at(from_, F.lit(1)), F.size(tokens)))


def _named(tokens: Column) -> Column:
    """struct(db, name) of the tokens name, or db . name."""
    dotted = _word(tokens, 2) == "."
    part = lambda i: _bare(F.try_element_at(tokens, F.lit(i)))
    return F.struct(F.when(dotted, part(1)).otherwise("").alias("db"), F.when(dotted, part(3)).otherwise(part(1)).alias("name"))


def _item(kind: str, action: str, name: Column, table: Column) -> Column:
    return F.struct(F.lit(kind).alias("object_type"), F.lit(action).alias("ddl_action"), name.alias("object_name"), table.alias("table_name"))


def ddl_events(statements: DataFrame, parity: bool = True) -> DataFrame:
    """statements (..., current_database, sql) with a row for each schema change in them: database_name, table_name,
    object_type, ddl_action, object_name, clause_no. Others give none; a table without a database needs a current one.

    parity: column clauses are tried first, so ADD INDEX x adds a column named INDEX; else index clauses are.
    """
    rows = statements.withColumn("_sql", squeezed(F.coalesce("sql", F.lit("")))).withColumn("_t", _tokens(F.col("_sql")))
    t = F.col("_t")
    verb = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WHOLE_VERBS.items() for x in kv)), _word(t, 1)), F.lit(""))
    object_ = _rest(_after(t, 1))
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), _word(object_, 1)), F.lit(""))
    own = _named(_rest(_after(object_, 1)))
    plain = F.struct(F.lit("").alias("db"), F.col("_own.name").alias("name"))
    on = F.array_position(F.transform(t, lambda x: F.upper(x)), "ON").cast("int")
    rows = rows.withColumn("_verb", verb).withColumn("_kind", kind).withColumn("_own", own).withColumn("_on", F.when(on > 0, _named(_after(t, on))))
    whole = F.struct(F.col("_kind").alias("object_type"), F.col("_verb").alias("ddl_action"), F.col("_own.name").alias("object_name"), F.when(F.col("_kind") == "database", "").when(F.col("_kind") == "index", F.col("_on.name")).otherwise(F.col("_own.name")).alias("table_name"))
    database = F.when(F.col("_kind") == "database", plain["name"]).when(F.col("_kind") == "index", F.col("_on.db")).otherwise(F.col("_own.db"))
    is_whole = (F.col("_verb") != "") & (F.col("_own.name") != "") & ((F.col("_kind").isin("database", "table")) | ((F.col("_kind") == "index") & (F.col("_on.name") != "")))
    # ALTER TABLE name clauses: what follows the name's last token
    alters = (_word(t, 1) == "ALTER") & (_word(t, 2) == "TABLE")
    target = _named(_after(t, 2))
    name_end = F.when(_word(t, 4) == ".", 5).otherwise(3)
    head = F.array_join(F.transform(F.slice(t, 1, name_end), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "\\s*")
    body = F.regexp_replace("_sql", F.concat(F.lit("^"), head, F.lit("\\s*")), F.lit(""))
    table = F.col("_target.name")

    def clause(c: Column) -> Column:
        """A clause by its verb and what the verb is said of; the kinds are tried in the order that parity asks for."""
        w = _tokens(c)
        verb = F.try_element_at(F.create_map(*(F.lit(x) for kv in CLAUSE_VERBS.items() for x in kv)), _word(w, 1))
        said = F.when(_word(w, 2) == "COLUMN", _after(w, 2)).otherwise(_after(w, 1))
        new_name = F.when(_word(w, 1) == "CHANGE", F.try_element_at(said, F.lit(2))).otherwise(F.try_element_at(said, F.lit(1)))
        column = F.when(verb.isNotNull() & (_bare(new_name) != ""), F.struct(F.lit("column").alias("object_type"), verb.alias("ddl_action"), _bare(new_name).alias("object_name"), table.alias("table_name")))
        of = _rest(_after(w, 1))
        action = F.when(_word(w, 1) == "ADD", "create").when(_word(w, 1) == "DROP", "drop")
        primary = (_word(of, 1) == "PRIMARY") & (_word(of, 2) == "KEY")
        keyed = _word(of, 1).isin("INDEX", "KEY") & (_bare(F.try_element_at(of, F.lit(2))) != "") & (F.try_element_at(of, F.lit(2)) != "(")
        index_name = F.when(primary, "PRIMARY").otherwise(_bare(F.try_element_at(of, F.lit(2))))
        index = F.when(action.isNotNull() & (primary | keyed), F.struct(F.lit("index").alias("object_type"), action.alias("ddl_action"), index_name.alias("object_name"), table.alias("table_name")))
        return F.coalesce(*((column, index) if parity else (index, column)), _item("table", "alter", table, table))

    rows = rows.withColumn("_target", F.when(alters, target)).withColumn("_body", F.when(alters, body))
    items = F.transform(clauses(F.col("_body")), clause)
    found = F.when(is_whole, F.struct(database.alias("db"), F.array(whole).alias("items"))).when(alters & (table != "") & (F.col("_body") != ""), F.struct(F.col("_target.db").alias("db"), items.alias("items")))
    rows = rows.withColumn("_f", found)
    database = F.coalesce(F.nullif(F.col("_f.db"), F.lit("")), F.nullif(F.trim("current_database"), F.lit("")))
    keep = [c for c in statements.columns if c not in ("sql", "current_database")]
    out = rows.select(*keep, database.alias("database_name"), F.posexplode_outer("_f.items").alias("clause_no", "i"))
    out = out.where("i is not null and database_name is not null")  # after the explosion: before it, the filter would hold the whole parse
    return out.select(*keep, "database_name", "i.table_name", "i.object_type", "i.ddl_action", "i.object_name", "clause_no")


#: Words that begin a clause of CREATE TABLE which is no column.
NO_COLUMN = ("PRIMARY", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "FOREIGN", "CHECK", "FULLTEXT", "SPATIAL")


def created_columns(sql: Column) -> Column:
    """The columns that a CREATE TABLE statement names, in order."""
    body = F.regexp_extract(squeezed(sql), "^[^(]*[(](.*)[)][^)]*$", 1)
    names = F.transform(clauses(body), lambda c: F.try_element_at(_tokens(c), F.lit(1)))
    return F.transform(F.filter(names, lambda n: n.isNotNull() & ~F.upper(n).isin(*NO_COLUMN)), _bare)
