import random
import unicodedata

import regex
from pyspark.sql import functions as F

from chatloom.functions import textform
from chatloom.functions.textform import is_settled, normal_form, normal_key

ALPHABET = list("aZ 9.\t\nßéÀĳſŉİıŁŻйЯёѐаеАनकी़क़ऩ।९‘”…•–½²ªº\u00ad\u200b\u200c\u200d\ufe0f\ufe0e\u0301\u0308\u00a0\u3000ＡﬁαΣς①㎏️👍🏽❤☕👨👩★❨🇩🇪¨´µ")


def long_way(text):
    form = textform.unify_scripts(unicodedata.normalize("NFKC", textform.strip_invisible(text)))
    return regex.sub(rf"[\s{textform.SPACES}]+", " ", unicodedata.normalize("NFKC", form.casefold())).strip()


def samples():
    rng = random.Random(1)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 9))) for _ in range(20000)] + ALPHABET + ["👨\u200d👩\u200d👧", "❤️", "क्\u200dष", "Anna  Maria ", "", " \n "]


def test_the_short_way_gives_the_same_form():
    texts = samples()
    assert [(t, normal_form(t)) for t in texts if normal_form(t) != long_way(t)] == []
    assert sum(map(is_settled, texts)) > 500


def test_native_and_python_form_agree(spark):
    rows = spark.createDataFrame([(t,) for t in samples()[-3000:]] + [(None,)], "t STRING")
    got = rows.select("t", normal_key(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got if r["n"] != normal_form(r["t"])] == []
