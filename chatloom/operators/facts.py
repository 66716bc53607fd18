"""Facts about people in one shape, and the evidence that leaves with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.operators.adjacent import running_count

# The kinds of facts that keep their name.
KINDS = "birthday place milestone work hobby food relationship personality funny other".split()


def collapsed(col: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def normalised_facts(facts: DataFrame, most: int = 5) -> DataFrame:
    """At most `most` facts of a person of a chat, in order: chat_id, person, place, category, fact, evidence.

    Unknown and missing kinds become `other`, texts are cut to 220 and 140 characters, facts without text are dropped, evidence is masked.
    """
    clean = facts.select(
        "chat_id", F.trim("person").alias("person"), "fact_id", F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("category"),
        F.substring(collapsed(F.col("fact")), 1, 220).alias("fact"), F.substring(ct.masked(collapsed(F.col("evidence"))), 1, 140).alias("evidence"),
    ).filter("fact <> ''")
    named = clean.withColumn("category", F.when(F.col("category").isin(*KINDS), F.col("category")).otherwise("other"))
    place = F.row_number().over(Window.partitionBy("chat_id", "person").orderBy("fact_id"))
    return named.withColumn("place", place).filter(F.col("place") <= most).select("chat_id", "person", "place", "category", "fact", "evidence")


def facts_of_people(facts: DataFrame, people: DataFrame) -> DataFrame:
    """Facts of the people who wrote in the chat, names compared without case and outer spaces."""
    known = people.select("chat_id", F.lower(F.trim("sender")).alias("_who")).distinct()
    return facts.join(known, (facts["chat_id"] == known["chat_id"]) & (F.lower(F.trim("person")) == F.col("_who")), "left_semi").groupBy("chat_id", "person").agg(F.count("*").alias("facts"))


def to_documents(normalised: DataFrame) -> DataFrame:
    """One JSON text per person, as they are served."""
    packed = normalised.groupBy("chat_id", "person").agg(F.sort_array(F.collect_list(F.struct("place", "category", "fact", "evidence"))).alias("facts"))
    return packed.select("chat_id", "person", F.to_json("facts").alias("json"))


def transcript(m: DataFrame, most: int = 150_000) -> DataFrame:
    """The lines of each chat in order, `[date time] sender: text`, for a reader of at most `most` characters: chat_id, line_no from 0, line.

    Lines without text are left out; where all together are longer, every n-th line stands for the rest. This thins a text for a reader, it is no sample of data.
    """
    said = m.withColumn("text", F.trim(F.regexp_replace("message", r"[\s\p{Z}]+", " "))).filter("text <> ''").withColumn("one", F.lit(True))
    line = F.concat(F.lit("["), F.coalesce("date", F.lit("")), F.lit(" "), F.coalesce("time", F.lit("")), F.lit("] "), F.col("sender"), F.lit(": "), F.col("text"))
    lines = running_count(said.select("chat_id", "msg_id", line.alias("line"), "one"), "chat_id", "msg_id", "one", "nth")
    size = lines.groupBy("chat_id").agg((F.sum(ct.utf16_length(F.col("line"))) + F.count("*") - 1).alias("size"))
    stride = F.when(F.col("size") <= most, F.lit(1)).otherwise(F.ceil(F.col("size") / most))
    return lines.join(size.select("chat_id", stride.cast("bigint").alias("stride")), "chat_id").filter((F.col("nth") - 1) % F.col("stride") == 0).select("chat_id", (F.col("nth") - 1).alias("line_no"), "line")


def json_within(col: Column) -> Column:
    """The JSON object in a text that a model wrote: code fences off, from the first brace to the last; null where that isn't JSON."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"(?i)^```(?:json)?", ""), r"```$", ""))
    begin = F.instr(bare, "{")
    end = F.char_length(bare) - F.instr(F.reverse(bare), "}") + 1
    body = F.when((begin > 0) & F.contains(bare, F.lit("}")) & (end > begin), F.substring(bare, begin, end - begin + 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def facts_in_documents(docs: DataFrame, text: str = "json") -> DataFrame:
    """Facts out of nested documents, a map from person to list of facts: the other columns, person, place, category, fact, evidence. What isn't such a document gives no rows."""
    kept = [c for c in docs.columns if c != text]
    read = F.from_json(json_within(F.col(text)), "map<string,array<struct<category:string,fact:string,evidence:string>>>")
    people = docs.select(*kept, F.explode(read).alias("person", "facts"))
    each = people.select(*kept, "person", F.posexplode("facts").alias("place", "f"))
    return each.select(*kept, "person", (F.col("place") + 1).alias("place"), "f.category", "f.fact", "f.evidence")


def chat_document(normalised: DataFrame) -> DataFrame:
    """All facts of a chat as one document, person to facts in order, in the fences that models put around JSON: chat_id, json."""
    of_person = normalised.groupBy("chat_id", "person").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "category", "fact", "evidence"))), lambda f: f.dropFields("place")).alias("facts"))
    whole = of_person.groupBy("chat_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("person", "facts"))))).alias("json"))
    return whole.select("chat_id", F.concat(F.lit("```json\n"), "json", F.lit("\n```")).alias("json"))
