"""What a question is about: its words, stems, phrases and intent. A question is one short text, so this runs once, by the same expressions as the index."""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct

# Pronouns, of which a question is not about any.
PRONOUNS = (
    "i me my mine myself we us our ours ourselves you your yours yourself yourselves u ur he him his himself she her hers herself they them their theirs themselves "
    "it its itself this that these those someone anyone everyone somebody anybody everybody main mera meri mere mujhe mujhko hum humara humari humare "
    "tu tera teri tere tujhe tum tumhara tumhari tumhare tumhe aap aapka aapki aapke apko yeh ye woh wo unka unki unke unhe unko inka inki inke inhe inko"
).split()
# Words of asking itself.
FILLERS = "say said saying tell told telling ask asked asking about mention mentioned talk talked talking discuss discussed thing things mean meaning give show find get got know knew".split()
# Words that speak for an intent, with what each adds to it.
INTENT_WORDS = {
    "preference": (2.0, "like love hate enjoy prefer fan hobby into favorite".split()),
    "opinion_sentiment": (2.0, "feel think opinion angry happy sad upset complain fight argue reaction".split()),
    "factual": (0.0, []),
    "temporal": (2.0, "when date time yesterday last ago first recently recent year month kab".split()),
    "frequency_comparison": (2.0, "often most least always never more faster longer frequency count".split()),
    "relationship_interaction": (1.5, "meet relationship together between".split()),
    "follow_up": (0.0, []),
}


@dataclass(frozen=True)
class Question:
    normal: str
    tokens: list[str]
    words: list[str]
    stems: list[str]
    topic: list[str]
    topic_stems: list[str]
    phrases: list[str]
    has_pronoun: bool
    intent: str

    @property
    def of_person_alone(self) -> bool:
        return not self.topic

    @property
    def soft(self) -> list[str]:
        """Words that a misspelt one may stand for."""
        return [t for t in self.topic or self.words if len(t) >= 4]


def ngrams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def analyse(spark: SparkSession, question: str) -> Question:
    """A question taken apart; an empty one has no words."""
    q = F.col("q")
    meaningful = ct.meaningful(q)
    row = spark.createDataFrame([(question or "",)], "q STRING").select(
        F.lower(ct.normal_chat(q)).alias("normal"), ct.tokens(q).alias("tokens"), meaningful.alias("words"), F.transform(meaningful, lambda w: ct.stem(w)).alias("stems")
    ).first()
    tokens, words = row["tokens"], row["words"]
    stem_of = dict(zip(words, row["stems"], strict=True))
    topic = [w for w in words if w not in ct.INTERROGATIVES and w not in PRONOUNS and w not in FILLERS and w not in ("did", "does", "do")]
    quoted = [(a or b).strip().lower() for a, b in regex.findall(r"\"([^\"]+)\"|'([^']+)'", question or "")]
    pronoun = any(t in PRONOUNS for t in tokens)
    scores = {name: gain * sum(w in said or (name == "preference" and stem_of[w] in said) for w in words) for name, (gain, said) in INTENT_WORDS.items()}
    scores["follow_up"] += 2.0 * (pronoun or row["normal"].startswith(("and ", "what about")))
    scores["factual"] += 1.5 * any(t in ct.INTERROGATIVES for t in tokens)
    # the first of equals, facts where nothing speaks
    best = max(scores, key=lambda k: scores[k])
    unique = lambda xs: list(dict.fromkeys(xs))
    return Question(
        row["normal"], tokens, unique(words), unique(row["stems"]), topic, unique(stem_of[w] for w in topic),
        [p for p in [*quoted, *ngrams(words, 3), *ngrams(words, 2)] if len(p) >= 3], pronoun, best if scores[best] > 0 else "factual",
    )


def question_type(col: Column) -> Column:
    """Which section of the report a question is for, or that it is one about the conversation."""
    low = F.lower(F.trim(col))
    fits = lambda *patterns: low.rlike("|".join(patterns))
    return (
        F.when(fits("\\b(?:who|which)[^\\n]*(?:talk|message|text|speak)"), "message_statistics")
        .when(fits("reply faster", "respond faster", "response time"), "response_statistics")
        .when(fits("longer messages", "long messages", "message length"), "message_length_statistics")
        .when(fits("start[^\\n]*conversation", "conversation[^\\n]*start"), "conversation_statistics")
        .otherwise("conversation_question")
    )


def suggestions(people: list[str]) -> list[str]:
    """Questions to begin with, of the first two people of a chat."""
    first, second = [*people, None, None][:2]
    own = [f"What does {first} like?", f"What did {first} say about plans?"] if first else []
    pair = [f"What do {first} and {second} talk about?"] if second else []
    return ["Who talks the most?", "Who replies fastest?", *own, *pair, "What is the busiest day?"][:6]
