"""Chat vocabulary and the column expressions of tokens, stems, emoji, masks."""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count among the most used words.
STOP_WORDS = (
    "the and for are but not you all can had her was one our out day get has him his how man new now old see two way who boy "
    "did does that this with have from they will would there their what about just like when then than your been were some them other over "
    "such into only also most much very should could hai hain nahi nhi kya kyun karan hoga hoki tha thi ho ka ke ki ko me mera meri "
    "tum tumhara acha accha theek haan han matlab bhai yaar nah okay ok hmm yeah yes bro dude wanna gonna really actually maybe right going "
    "know good want need make made come came take took give gave look looking thing things stuff"
).split()
# Words that carry no meaning in retrieval.
LIGHT_STOP_WORDS = "a an the of at by in on to from with into onto is are was were am be been being and or so than then u ur r pls plz".split()
# Question words.
INTERROGATIVES = "what when where why who which how kya kab kahan kyun kyu kaise kon kaun kisne kisko".split()
# Negating words.
NEGATIONS = "not n't no never none neither nor hardly barely nahi nhi nai ni nhn mat na".split()
# First words of short answers.
AFFIRMATIVE = "yes yeah yup yep haan han haa haanji ok okay sure obviously bilkul sahi right correct true hmm exactly absolutely ofcourse".split()
NEGATIVE = "no nope nahi nhi nai nah never galat wrong false nahita not".split()
# Spellings of chat and the word they stand for.
CANONICAL = {
    "nhi": "nahi", "nai": "nahi", "ni": "nahi", "nhn": "nahi", "na": "nahi", "hn": "haan", "han": "haan", "haa": "haan", "haanji": "haan",
    "yea": "yes", "yeah": "yes", "yup": "yes", "yep": "yes", "h": "hai", "hain": "hai", "pta": "pata", "bta": "bata", "btao": "bata",
    "kr": "kar", "kro": "kar", "krna": "kar", "karna": "kar", "krta": "kar", "karta": "kar", "krti": "kar", "karti": "kar", "kyu": "kyun", "kyon": "kyun",
    "kaha": "kahan", "kahaan": "kahan", "mje": "mujhe", "mjhe": "mujhe", "mra": "mera", "mri": "meri", "tme": "tumhe", "tmhara": "tumhara", "mtlb": "matlab",
    "acha": "accha", "achha": "accha", "thik": "theek", "thk": "theek", "bcz": "because", "bcuz": "because", "coz": "because", "cuz": "because", "abt": "about",
    "fav": "favorite", "favourite": "favorite", "favrt": "favorite", "msg": "message", "txt": "message", "pic": "photo", "pics": "photo",
    "thx": "thanks", "tysm": "thanks", "ty": "thanks", "idk": "unknown", "tbh": "honestly", "rn": "now",
}
# Verb forms and their stem.
IRREGULAR = {
    "went": "go", "gone": "go", "goes": "go", "going": "go", "ate": "eat", "eaten": "eat", "eating": "eat", "eats": "eat", "bought": "buy", "buying": "buy", "buys": "buy",
    "saw": "see", "seen": "see", "seeing": "see", "sees": "see", "heard": "hear", "hearing": "hear", "hears": "hear", "sent": "send", "sending": "send", "sends": "send",
    "made": "make", "making": "make", "makes": "make", "ran": "run", "running": "run", "runs": "run", "wrote": "write", "written": "write", "writing": "write", "writes": "write",
    "read": "read", "reading": "read", "reads": "read", "spoke": "speak", "spoken": "speak", "speaking": "speak", "speaks": "speak", "talked": "talk", "talking": "talk", "talks": "talk",
    "liked": "like", "liking": "like", "likes": "like", "loved": "love", "loving": "love", "loves": "love", "hated": "hate", "hating": "hate", "hates": "hate",
    "cooked": "cook", "cooking": "cook", "cooks": "cook", "baked": "bake", "baking": "bake", "bakes": "bake", "travelled": "travel", "traveled": "travel", "traveling": "travel", "travels": "travel",
    "played": "play", "playing": "play", "plays": "play", "watched": "watch", "watching": "watch", "watches": "watch", "listened": "listen", "listening": "listen", "listens": "listen",
    "argued": "argue", "arguing": "argue", "argues": "argue",
}
# Contractions and what they expand to, in this order.
CONTRACTIONS = [
    ("can't", "cannot"), ("won't", "will not"), ("don't", "do not"), ("doesn't", "does not"), ("didn't", "did not"), ("isn't", "is not"), ("aren't", "are not"),
    ("wasn't", "was not"), ("weren't", "were not"), ("haven't", "have not"), ("hasn't", "has not"), ("hadn't", "had not"), ("i'm", "i am"), ("you're", "you are"),
    ("they're", "you are"), ("we're", "we are"), ("it's", "it is"),
]
# Bank handles of payment addresses, words before a code.
PAY_HANDLES = "okhdfc oksbi okicici okaxis paytm ybl ibl axl upi okbizaxis".split()
CODE_WORDS = r"otp|o\.t\.p|code|codigo|pin|password|pass"
#: ASCII word edges, whatever the engine takes a word to be.
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
LINK = r"(?i)https?://\S+"


@lru_cache(maxsize=1)
def emoji_class() -> str:
    """Character class of pictographs, in a form that both Java and RE2 read."""
    rx, ranges = regex.compile(r"\p{Extended_Pictographic}"), []
    for cp in [*range(0xA9, 0xD800), *range(0xE000, 0x20000)]:
        if rx.match(chr(cp)):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return F.char_length(col) + F.char_length(F.regexp_replace(col, r"[^\x{10000}-\x{10FFFF}]", ""))


def emojis(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(emoji_class()), F.lit(0))


def words(col: Column) -> Column:
    """Words that count among the most used: lower case, letters and digits, longer than two, no stop words."""
    plain = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP_WORDS))


def normal_chat(col: Column) -> Column:
    """Straight apostrophes, no zero-width characters, contractions expanded, no run of a character over two."""
    out = F.regexp_replace(F.regexp_replace(col, r"[\x{200B}-\x{200D}\x{FEFF}]", ""), "[‘’]", "'")
    whole = out
    for short, full in CONTRACTIONS:
        whole = F.regexp_replace(whole, f"(?i){EDGE_L}{short}{EDGE_R}", full)
    # every contraction has an apostrophe, most texts have none
    out = F.when(out.contains("'"), whole).otherwise(out)
    return F.trim(F.regexp_replace(out, r"(.)\1{2,}", "$1$1"))


def tokens_of(normal: Column) -> Column:
    """Tokens of a text in `normal_chat` form."""
    return F.regexp_extract_all(F.lower(normal), F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0))


def tokens(col: Column) -> Column:
    return tokens_of(normal_chat(col))


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), key)


def meaningful(col: Column) -> Column:
    """Tokens in their usual spelling, two letters or more, no light stop words."""
    return meaningful_of(tokens(col))


def meaningful_of(said: Column) -> Column:
    return F.filter(F.transform(said, lambda t: mapped(CANONICAL, t)), lambda t: (F.char_length(t) >= 2) & ~t.isin(*LIGHT_STOP_WORDS))


def stem(token: Column) -> Column:
    """Stem of a lower-case token: listed forms, else the first suffix that fits; tokens up to three letters stay."""
    n = F.char_length(token)
    cut = lambda c, k: F.substring(c, F.lit(1), F.char_length(c) - k)
    ing, ed = cut(token, 3), cut(token, 2)
    single = F.when(ing.rlike("(mm|nn|tt|pp)$"), cut(ing, 1)).otherwise(ing)
    back = F.when(ed.endswith("i"), F.concat(cut(ed, 1), F.lit("y"))).otherwise(ed)
    cutting = (
        F.when(token.endswith("ing") & (n > 5), single).when(token.endswith("ed") & (n > 4), back).when(token.endswith("es") & (n > 4), ed)
        .when(token.endswith("s") & ~token.endswith("ss"), cut(token, 1)).when(token.endswith("tion") & (n > 6), cut(token, 4)).when(token.endswith("ly") & (n > 4), ed)
        .otherwise(token)
    )
    listed = F.try_element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), token)
    return F.when(n <= 3, token).otherwise(F.coalesce(listed, F.when(F.char_length(cutting) >= 2, cutting).otherwise(token)))


def trigrams(col: Column) -> Column:
    padded = F.concat(F.lit("  "), col, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """Share of common trigrams."""
    return 2.0 * F.size(F.array_intersect(trigrams(a), trigrams(b))) / (F.size(trigrams(a)) + F.size(trigrams(b)))


def fuzzy(a: Column, b: Column) -> Column:
    """Similarity of two tokens of four letters or more within one edit (two from six letters on) if at least 0.8, else null."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    near = F.abs(F.char_length(a) - F.char_length(b)) <= F.when(longest <= 5, 1).otherwise(2)
    distance = F.levenshtein(a, b, 2)
    score = 1 - distance / longest
    return F.when((F.char_length(a) >= 4) & (F.char_length(b) >= 4) & near & (distance >= 0) & (distance <= F.when(longest <= 5, 1).otherwise(2)) & (score >= 0.8), score)


def masked(col: Column) -> Column:
    """Cards, phones, mail addresses, payment handles and one-time codes masked, in this order."""
    out = F.regexp_replace(col, rf"{EDGE_L}\d{{4}}([\s-]?)\d{{4}}([\s-]?)\d{{4}}([\s-]?)\d{{4}}{EDGE_R}", "XXXX$1XXXX$2XXXX$3XXXX")
    out = F.regexp_replace(out, r"(\+\d{1,3})([\s-]?)\d{5}([\s-]?)\d{5}", "$1$2XXXXX$3XXXXX")
    out = F.regexp_replace(out, rf"{EDGE_L}\d{{10}}{EDGE_R}", "X" * 10)
    out = F.regexp_replace(out, rf"{EDGE_L}([A-Za-z0-9_.+-]+)@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_.-]+)+(?<=[A-Za-z0-9_]){EDGE_R}", "$1@XXXXX")
    out = F.regexp_replace(out, rf"(?i){EDGE_L}([A-Za-z0-9_.-]+)@(?:{'|'.join(PAY_HANDLES)}){EDGE_R}", "$1@XXXXX")
    for n in range(8, 3, -1):
        out = F.regexp_replace(out, rf"(?i){EDGE_L}((?:{CODE_WORDS}){EDGE_R}[^0-9\n]{{0,12}})\d{{{n}}}{EDGE_R}", "$1" + "X" * n)
    return out


def quality(col: Column) -> Column:
    """Weight of a message in retrieval: 0.1 for boilerplate, 0.5 for one or two characters, 0 for nothing."""
    low = F.lower(col)
    # Parts of messages that the app itself wrote.
    boilerplate = ["messages and calls are end-to-end encrypted", "this message was deleted", "you deleted this message", "<media omitted>", "missed voice call", "missed video call"]
    auto = low.contains(boilerplate[0])
    for b in boilerplate[1:]:
        auto = auto | low.contains(b)
    return F.when(F.coalesce(col, F.lit("")) == "", 0.0).when(auto, 0.1).when(utf16_length(col) < 3, 0.5).otherwise(1.0)


def short_answer(col: Column) -> Column:
    """1 for a short yes, -1 for a short no, else 0."""
    return short_answer_of(tokens(col))


def short_answer_of(t: Column) -> Column:
    first = mapped(CANONICAL, F.get(t, F.lit(0)))
    return F.when(~F.size(t).between(1, 3), 0).when(first.isin(*AFFIRMATIVE), 1).when(first.isin(*NEGATIVE), -1).otherwise(0)


def is_question(col: Column) -> Column:
    return asks_of(col, tokens(col))


def asks_of(col: Column, said: Column) -> Column:
    return col.contains("?") | F.coalesce(F.get(said, F.lit(0)).isin(*INTERROGATIVES), F.lit(False))
