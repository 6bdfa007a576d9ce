"""Operator 10, line dedup: a log-template tree of fixed depth.

Tokens with a digit are variable fields and masked, unless few others would be left. A line's leaf
is its number of tokens and its first tokens. Within a leaf, a token that recurs at its position is
constant, any other is a variable field too; a line whose tokens are mostly constant takes the
template in which its other fields are masked, and any other line is its own template. Lines of few
tokens, and those without spaces, have no fields: each is its own template, and has to occur more
often. Templates that occur in enough different documents are dropped, except in the first document
that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import col, documents, few, pin, text_of

#: Leading tokens that lead to a leaf, after the number of tokens.
DEPTH = 3
#: A template recurs if documents of this many different texts have it, and so does a constant token.
MIN_DOCS = 5
#: Least share of constant tokens in a line that takes a template with variable fields.
SIMILARITY = 0.7
#: Shorter lines have no variable fields and recur from this many different texts on: a few words
#: may do so by chance.
MIN_TOKENS = 4
SHORT_DOCS = 10
_SPACE = " \\t\\x0B\\f\\r"
_WILD = "<*>"
_WITH_DIGIT = f"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*"


def _lines(docs: DataFrame, similarity: float) -> DataFrame:
    """``doc_key, doc_id, content, pos, n, masked, leaf, line`` of every line that is not blank.

    ``docs`` has ``doc_key, doc_id, content, text``. Patterns run on the few texts and lines that
    need them; the rest is counted and cut without any.
    """
    text = F.col("text")
    signs = ["\t", "\x0b", "\f", "\r", "  ", " \n", "\n "]
    loose = text.startswith(" ") | text.endswith(" ")
    for sign in signs:
        loose = loose | F.contains(text, F.lit(sign))
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(text, f"[{_SPACE}]+", " "), " ?\n ?", "\n"), F.lit(" "))
    plain = docs.withColumn("text", F.when(loose, tidy).otherwise(text)).withColumn("lines", F.split("text", "\n", -1)).drop("text")
    lines = plain.select("doc_key", "doc_id", "content", F.posexplode("lines").alias("pos", "plain"))
    spaces = F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit("")))
    filled = lines.where(F.col("plain") != "").withColumn("n", spaces + 1)
    variable = (F.col("n") >= MIN_TOKENS) & F.col("plain").rlike("[0-9]")
    masked = filled.withColumn("masked", F.when(variable, F.regexp_replace("plain", _WITH_DIGIT, _WILD)))
    wild = (F.length("masked") - F.length(F.replace("masked", F.lit(_WILD), F.lit("")))) / len(_WILD)
    chosen = F.when(F.col("n") - wild >= F.col("n") * similarity, F.col("masked")).otherwise(F.col("plain"))
    return (
        masked.withColumn("masked", chosen).drop("plain")
        .withColumns({"leaf": F.xxhash64("n", F.substring_index("masked", " ", DEPTH)), "line": F.xxhash64("masked")})
    )


def _templates(distinct: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """``leaf, line, template`` for lines whose template is not the line itself."""
    distinct = distinct.where(F.col("n") >= MIN_TOKENS)
    rare = distinct.where(F.col("texts") < min_docs)
    tokens = distinct.select("leaf", "line", "n", "texts", F.posexplode(F.split("masked", " ", -1)).alias("at", "token"))
    constant = tokens.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("t")).where(F.col("t") >= min_docs).drop("t")
    constant = pin(constant.withColumn("fixed", F.lit(True)), "constant-tokens")
    fields = rare.select("leaf", "line", "n", F.posexplode(F.split("masked", " ", -1)).alias("at", "token"))
    known = fields.join(constant, ["leaf", "at", "token"])
    return (
        known.groupBy("leaf", "line", "n")  # a line's own tokens
        .agg(F.count_if(F.col("token") != _WILD).alias("fixed"), F.array_sort(F.collect_list(F.struct("at", "token"))).alias("parts"))
        .where((F.col("fixed") >= F.col("n") * similarity) & (F.size("parts") < F.col("n")))
        .select("leaf", "line", F.xxhash64("n", "parts").alias("template"))
    )


def recurring_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
    short_docs: int = SHORT_DOCS,
) -> DataFrame:
    """``doc_key, dropped``: the positions (from 0) of the lines to drop, per document that has any."""
    text = text_of(text_col)
    docs = df.select(
        col(id_col).alias("doc_id"), F.xxhash64(col(id_col), text).alias("doc_key"), F.xxhash64(text).alias("content"), text.alias("text")
    )
    # Hashes only: most lines are alone in their leaf, and their text is not needed again.
    lines = pin(_lines(docs, similarity).drop("masked"), "lines")
    busy = lines.groupBy("leaf").agg(F.count("*").alias("c"), F.min("content").alias("least"), F.max("content").alias("most"))
    busy = pin(busy.where((F.col("c") >= min_docs) & (F.col("least") < F.col("most"))).select("leaf"), "busy-leaves")
    pinned = pin(lines.join(busy, "leaf", "left_semi"), "tree-lines")
    counted = pinned.groupBy("leaf", "line", "n", "content").agg(F.min("doc_key").alias("doc_key"))
    counted = pin(counted.groupBy("leaf", "line", "n").agg(F.count("*").alias("texts"), F.min("doc_key").alias("doc_key")), "counted-lines")
    # One document per line lends its text.
    lenders = few(pin(counted.select("doc_key").distinct(), "lenders"))
    lent = _lines(docs.join(lenders, "doc_key", "left_semi"), similarity).select("doc_key", "leaf", "line", "n", "masked")
    lent = lent.join(counted, ["doc_key", "leaf", "line", "n"]).dropDuplicates(["leaf", "line", "n"])
    distinct = pin(lent.select("leaf", "line", "n", "masked", "texts"), "distinct-lines")
    general = _templates(distinct, min_docs, similarity)
    named = distinct.select("leaf", "line", "n", "texts").join(general, ["leaf", "line"], "left").select(
        "leaf", "line", "n", "texts", F.coalesce("template", "line").alias("template"), F.col("template").isNotNull().alias("general")
    )
    named = pin(named, "named-lines")
    # A template with fields and a line without any may still be the same lines' hash: keep both apart.
    placed = pinned.select("doc_key", "doc_id", "content", "pos", "leaf", "line").join(named, ["leaf", "line"])
    key = ["leaf", "n", "template", "general"]
    recurring = (
        placed.groupBy(*key, "content").agg(F.min(F.struct("doc_id", "doc_key")).alias("first"))
        .groupBy(*key).agg(F.count("*").alias("texts"), F.min("first.doc_id").alias("least"), F.min_by("first.doc_key", "first").alias("keeper"))
        .where(F.col("texts") >= F.when(F.col("n") < MIN_TOKENS, short_docs).otherwise(min_docs))
    )
    hits = placed.join(pin(recurring.select(*key, "keeper"), "recurring"), key).where("doc_key <> keeper")
    return hits.groupBy("doc_key").agg(F.collect_set("pos").alias("dropped"))  # a document's own lines


def drop_recurring_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
    short_docs: int = SHORT_DOCS,
) -> DataFrame:
    """The input's rows with recurring lines gone from the text, and ``n_lines`` and ``n_dropped``.

    Lines end at a line feed. A template stays in the document of the least id (null least) that
    has it, so nothing is lost; copies of one text count as one document, so a text is not emptied
    because it was copied. Repeated rows are treated alike. A null text stays null and has no
    lines; an empty one has one empty line. Blank lines stay. An empty table gives an empty result.
    Other columns are kept; input columns named ``n_lines`` or ``n_dropped``, in any case, are
    replaced.
    """
    drops = pin(recurring_lines(df, id_col, text_col, min_docs, similarity, short_docs), "drops")
    text = text_of(text_col)
    packed = df.select(
        F.struct(*[col(c) for c in df.columns]).alias("row"), F.xxhash64(col(id_col), text).alias("doc_key")
    )
    own = F.col("row").getField(text_col)
    lines = F.split(own, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    cleaned = F.when(F.col("dropped").isNull(), own).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    # The lists of lines grow with the corpus, so they are never broadcast.
    joined = packed.join(drops.hint("merge"), "doc_key", "left")
    kept = [
        (cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns if c.lower() not in ("n_lines", "n_dropped")
    ]
    return joined.select(
        *kept,
        F.when(own.isNull(), 0).otherwise(F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
    )


def op10_line_dedup(spark, sf_dir):
    return drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


OP10_SQL = rf"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents),
plain as (
  select doc_id, text, pos, string_split(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')), ' ') as raw from lines),
masked as (select *, [case when regexp_matches(t, '[0-9]') then '{_WILD}' else t end for t in raw] as ms from plain),
tokens as (
  select doc_id, text, pos, case when len(raw) >= {MIN_TOKENS} and len([t for t in ms if t <> '{_WILD}']) >= len(raw) * {SIMILARITY} then ms else raw end as ts from masked),
leaves as (select doc_id, text, pos, ts, len(ts)::varchar || ' ' || array_to_string(ts[1:{DEPTH}], ' ') as leaf from tokens where ts <> ['']),
busy as (select * from leaves where leaf in (select leaf from leaves group by leaf having count(*) >= {MIN_DOCS})),
uniq as (select leaf, ts, count(distinct text) as texts from busy where len(ts) >= {MIN_TOKENS} group by all),
parts as (select leaf, ts, texts, unnest(ts) as token, generate_subscripts(ts, 1) as i from uniq),
fixed as (select leaf, i, token from parts group by all having sum(texts) >= {MIN_DOCS}),
general as (
  select leaf, ts, list(i::varchar || ' ' || token order by i) as template
  from parts join fixed using (leaf, i, token) where texts < {MIN_DOCS} group by leaf, ts
  having count(*) filter (token <> '{_WILD}') >= len(ts) * {SIMILARITY} and count(*) < len(ts)),
named as (
  select b.doc_id, b.text, b.pos, b.leaf, coalesce(g.template, b.ts) as template, g.template is not null as general
  from busy b left join general g on b.leaf = g.leaf and b.ts = g.ts),
recurring as (
  select leaf, template, general, min(doc_id) as keeper from named group by all
  having count(distinct text) >= case when split_part(leaf, ' ', 1)::int < {MIN_TOKENS} then {SHORT_DOCS} else {MIN_DOCS} end),
dropped as (
  select n.doc_id, list(n.pos) as ps from named n join recurring r on n.leaf = r.leaf and n.template = r.template and n.general = r.general
  where n.doc_id <> r.keeper group by n.doc_id)
select d.doc_id,
  case when p.ps is null then d.text else
    array_to_string([string_split(d.text, chr(10))[j] for j in range(1, len(string_split(d.text, chr(10))) + 1) if not list_contains(p.ps, j)], chr(10)) end as text,
  len(string_split(d.text, chr(10)))::int as n_lines, coalesce(len(p.ps), 0)::int as n_dropped
from documents d left join dropped p using (doc_id)
"""
