"""Chat formatting by quotation linking, with DataFrame operations only.

Lines that begin with ``>`` marks are quotes; their level is the number of
marks.  Consecutive lines of one level form a passage.  Quoted passages are
normalised (marks off, white space squeezed, lower case) and hashed, and joined
to the hashes of messages' own lines, runs of lines and whole own texts: first in the same
conversation, to the nearest earlier message, else to the first message of another conversation
that has the passage.  A message's parent is the original of its first
passage of level one.  Messages lose their quoted lines, and each gets a reply
path: its parent's path with its own turn, so that ordering a conversation by
path puts replies after what they answer.

A quote of several lines can be an excerpt.  Its first line and number of lines
say where in own texts such a run of lines could begin; only these runs are made
and compared.  Blank lines don't count, quoted lines don't interrupt own ones.

Frequent passages: originals are reduced to one row for each hash (and for each
conversation and hash) by partial sums before the join, and only hashes that
somebody quotes are kept, so no passage is collected.

Defined results: null text has no passages and stays null; a quote without an
original links nowhere; a link to a later message or to itself is none; a
repeated (conversation, turn) gives one row each, of one path; rows with a null
conversation or turn link nowhere, and nothing links to them; paths begin at the root, however deep a reply
is, and hold turns of any size or sign (so a chain of d replies has paths of d * d / 2
steps in all; depth and parent say the same in few bytes); very long texts are parsed whole; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barproof.llm import graph

MARKS = r"^(?:[ \t]*>)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def passages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, pos, level, body (normalised), hash, first (hash of its first line) and n (lines) of each passage; level 0 is the message's own words."""
    lines = F.split(F.col("text"), r"\r?\n")
    own = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    plain = own.where(~F.col("text").rlike(r"(?m)" + MARKS)).select("conv", "turn", F.posexplode(lines).alias("pos", "line")).select("conv", "turn", "pos", F.lit(0).alias("level"), "line")
    # a passage begins where the level changes or, among own lines, at each line; each step reads the arrays of the one before
    quoting = own.where(F.col("text").rlike(r"(?m)" + MARKS)).select("conv", "turn", lines.alias("lines"))
    quoting = quoting.select("conv", "turn", F.transform("lines", lambda x: F.trim(F.regexp_replace(x, MARKS, ""))).alias("lines"), F.transform("lines", _level).alias("levels"))
    starts = F.zip_with("levels", F.concat(F.array(F.lit(-1)), F.slice("levels", 1, F.size("levels") - 1)), lambda x, before: (x == 0) | (x != before))
    quoting = quoting.withColumn("begin", F.filter(F.transform(starts, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    quoting = quoting.withColumn("end", F.concat(F.slice("begin", 2, F.size("begin")), F.array(F.size("lines"))))
    merged = F.zip_with("begin", "end", lambda x, y: F.struct(F.element_at(F.col("levels"), x + 1).alias("level"), F.array_join(F.slice(F.col("lines"), x + 1, y - x), "\n").alias("line")))
    quoting = quoting.select("conv", "turn", F.posexplode(merged).alias("pos", "p")).select("conv", "turn", "pos", "p.level", "p.line")
    out = plain.union(quoting).withColumn("body", _normal(F.col("line"))).where("body <> ''")
    several = _lines(F.col("line"))
    return out.select("conv", "turn", "pos", "level", "body", F.xxhash64("body").alias("hash"), F.when(F.col("level") > 0, F.xxhash64(F.element_at(several, 1))).alias("first"), F.when(F.col("level") > 0, F.size(several)).alias("n"))


def _lines(text: Column) -> Column:
    """Normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), _normal), lambda x: x != "")


def excerpts(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, turn, body of the runs of own lines (own: conv, turn, text without quotes) that begin and count as a quoted passage of several lines does."""
    asked = quoted.where("n > 1").select("first", "n").distinct()
    known = own.where("conv IS NOT NULL AND turn IS NOT NULL AND text LIKE '%\n%'").withColumn("key", F.xxhash64("text"))
    # where runs could begin: lines travel as hashes, and only messages that have such a line are read again
    begin = known.select("conv", "turn", "key", F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x))).alias("at", "first"))
    begin = begin.join(asked, "first").groupBy("conv", "turn", "key").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    found = known.join(begin, ["conv", "turn", "key"]).select("conv", "turn", _lines(F.col("text")).alias("all"), F.explode("runs").alias("run"))
    found = found.where(F.col("run.at") + F.col("run.n") <= F.size("all"))
    return found.select("conv", "turn", F.array_join(F.slice("all", F.col("run.at") + 1, F.col("run.n")), " ").alias("body"))


def without_quotes(text: Column) -> Column:
    kept = F.filter(F.split(text, r"\r?\n"), lambda x: _level(x) == 0)
    return F.when(text.rlike(r"(?m)" + MARKS), F.trim(F.array_join(kept, "\n"))).otherwise(text)


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, pos, level, hash of each quoted passage, with the original's to_conv and to_turn (null if none)."""
    found = passages(messages, conv_col, turn_col, text_col)
    quoted = found.where("level > 0").select("conv", "turn", "pos", "level", "hash", "body", "first", "n")
    wanted = quoted.select("hash", "body").distinct()
    own = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), without_quotes(F.col(text_col).cast("string")).alias("text"))
    whole = own.select("conv", "turn", _normal(F.col("text")).alias("body"))
    originals = found.where("level = 0").select("conv", "turn", "body").union(whole.where("body <> ''")).union(excerpts(own, quoted)).withColumn("hash", F.xxhash64("body"))
    originals = originals.where("conv IS NOT NULL AND turn IS NOT NULL").join(wanted, ["hash", "body"], "left_semi")
    # nearest earlier message of the same conversation: one pass over originals and quotes in order of turns
    asked = quoted.select("conv", "turn", "hash", "body").distinct()
    in_conv = originals.select("conv", "turn", "hash", "body").distinct()
    both = in_conv.withColumn("to", F.col("turn")).unionByName(asked.withColumn("to", F.lit(None).cast("long")))
    before = Window.partitionBy("conv", "hash", "body").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("to", ignorenulls=True).over(before)).where("to IS NULL AND near IS NOT NULL").drop("to")
    by_conv = originals.groupBy("hash", "body", "conv").agg(F.min("turn").alias("turn"))
    anywhere = by_conv.groupBy("hash", "body").agg(F.min(F.struct("conv", "turn")).alias("first"))
    out = quoted.drop("first", "n").join(near, ["conv", "turn", "hash", "body"], "left").join(anywhere, ["hash", "body"], "left")
    # the first message of all may be a later one of the quote's own conversation: then the first of another one counts
    own_first = F.col("near").isNull() & (F.col("first.conv") == F.col("conv"))
    asked = out.where(own_first & F.col("turn").isNotNull()).select("hash", "body", F.col("conv").alias("not")).distinct()  # one conversation for each passage
    others = by_conv.join(asked, ["hash", "body"]).where("conv <> not").groupBy("hash", "body").agg(F.min(F.struct("conv", "turn")).alias("other"))
    out = out.join(others, ["hash", "body"], "left")
    to = F.when(F.col("near").isNotNull(), F.struct("conv", F.col("near").alias("turn"))).when(own_first, F.col("other")).when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), F.col("first"))
    return out.select("conv", "turn", "pos", "level", "hash", to["conv"].alias("to_conv"), to["turn"].alias("to_turn"))


def build_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, n_linked, parent_conv, parent_turn, depth and path of each message."""
    graph.shared_folder(messages)
    links = link_quotes(messages, conv_col, turn_col, text_col)
    per = links.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("to_turn").alias("n_linked"),
        F.min(F.when((F.col("level") == 1) & F.col("to_turn").isNotNull(), F.struct("pos", "to_conv", "to_turn"))).alias("p")).checkpoint()
    # every turn a long can be, in an order that strings keep: "-" stands before all digits
    step = lambda c: F.when(c < 0, F.concat(F.lit("-"), F.lpad((c.cast("decimal(20,0)") + F.lit(2**63 - 1) + F.lit(1)).cast("string"), 19, "0"))).otherwise(F.lpad(c.cast("string"), 19, "0"))
    # a parent in the same conversation decides the path; each round joins the path of the top found so far, so that lengths double
    inside = per.where("p IS NOT NULL AND p.to_conv = conv").select("conv", "turn", F.col("p.to_turn").alias("up"))
    paths = inside.select("conv", "turn", "up", step(F.col("turn")).alias("path"), F.lit(1).alias("depth")).checkpoint()
    further = lambda: paths.select("conv", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
    while not paths.join(further(), ["conv", "up"], "left_semi").isEmpty():  # links go to earlier turns, so this ends
        more = F.col("_up").isNotNull()
        paths = paths.join(further(), ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("_up", "up").alias("up"), F.when(more, F.concat_ws("/", "_path", "path")).otherwise(F.col("path")).alias("path"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")).checkpoint()
    paths = paths.withColumn("path", F.concat_ws("/", step(F.col("up")), "path"))
    own = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), without_quotes(F.col(text_col).cast("string")).alias("text"))
    out = own.join(per, ["conv", "turn"], "left").join(paths.select("conv", "turn", "path", "depth"), ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("p.to_conv").alias("parent_conv"), F.col("p.to_turn").alias("parent_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("path", step(F.col("turn"))).alias("path"))
