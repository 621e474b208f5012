"""Chat formatting: typed content parts flattened into one escaped, masked string. DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, units). A visitor, one expression for each kind, turns a
text part into escaped text and an image, audio or document part into a placeholder `<kind:n>`, n counting the
conversation's attachments in order, a part of any other kind into nothing; the attachments' references and expanded token counts go to columns of their own.

Template: `<turn:ROLE>BODY</turn>` and a line feed for each turn. In roles and bodies, `\\` becomes `\\b` and `<`
becomes `\\l`, and in roles `>` becomes `\\g`, so no text can hold a control string; undoing `\\l` first and `\\b` second restores it exactly.

Defined results: null text or null parts are empty; null roles are empty; repeated (conversation, turn) rows are all
kept, in order of turn (null first), role, text; null conversation ids form one conversation; no rows give no rows;
very long
texts are formatted whole; other columns, whatever their names, are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:bigint>"
#: Tokens that one unit of a kind expands to: a tile of an image, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
OPEN, SHUT, END = "<turn:", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    """One text part of a plain string."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def _is_attachment(part: Column) -> Column:
    return part["kind"].isin(*TOKENS_PER_UNIT)


def _is_text(part: Column) -> Column:
    """A null kind is text."""
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _expanded(part: Column) -> Column:
    per = F.lit(0)
    for kind, tokens in TOKENS_PER_UNIT.items():
        per = F.when(part["kind"] == kind, tokens).otherwise(per)
    return (F.coalesce(part["units"], F.lit(1)) * per).cast("long")


def _visit(parts: Column, first: Column) -> Column:
    """Body of a turn whose attachments are numbered from first."""

    def one(part: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(parts, 1, i), _is_attachment))
        return F.when(_is_attachment(part), F.concat(F.lit("<"), part["kind"], F.lit(":"), (first + before).cast("string"), F.lit(">"))).when(_is_text(part), escaped(part["text"])).otherwise("")

    return F.array_join(F.transform(parts, one), "")


def format_parts(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, parts array<PART>) -> conv_id, formatted, loss_spans array<struct<start,length>>,
    attachments array<struct<n,kind,ref,tokens>>. Spans count code points of formatted and cover assistant bodies."""
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    has_files = F.exists("turns", lambda t: F.exists(t["parts"], _is_attachment))
    counted = conv.withColumn("flat", F.when(has_files, F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), _is_attachment)).otherwise(F.array().cast(f"array<{PART}>")))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array_join(F.transform(t["parts"], lambda p: F.when(_is_text(p), escaped(p["text"])).otherwise("")), "").alias("body")))
    rich = F.transform(
        "turns",
        lambda t, i: F.struct(t["role"].alias("role"), _visit(t["parts"], F.size(F.filter(F.flatten(F.transform(F.slice("turns", 1, i), lambda u: u["parts"])), _is_attachment))).alias("body")),
    )
    bodies = counted.withColumn("bodies", F.when(F.size("flat") > 0, rich).otherwise(plain))
    heads = bodies.withColumn("turn_texts", F.transform("bodies", lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit(SHUT), t["body"], F.lit(END))))
    placed = heads.withColumn("ends", _running(F.transform("turn_texts", F.length)))
    spans = F.filter(
        F.zip_with(
            "bodies",
            "ends",
            lambda t, e: F.struct(t["role"].alias("role"), (e - F.length(t["body"]) - len(END)).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")),
        ),
        lambda s: s["role"] == "assistant",
    )
    return placed.select(
        "conv_id",
        F.array_join("turn_texts", "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.transform("flat", lambda p, i: F.struct(i.alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))).alias("attachments"),
    )


def _running(lengths: Column) -> Column:
    """Running sums of an array of lengths, in one pass."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(lengths, zero, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["all"], F.array(a["sum"] + n)).alias("all")))["all"]


def parse(formatted: Column) -> Column:
    """Turns read back from the output: array<struct<role,text>> in order, unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SHUT, 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, SHUT) + 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns, all read back from formatted and its spans."""
    read = formatted.select("conv_id", "formatted", "attachments", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )
