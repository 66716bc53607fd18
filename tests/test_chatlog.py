import os

from chatloom.session import scratch_path
from chatloom.sources.chatlog import parse_exports, read_exports, refused_files

LOG = """junk before
12/08/25, 10:00 am - Messages and calls are end-to-end encrypted
still the notice
12/08/25, 10:01 am - Ana: hello
  second line

third line
13/08/2025, 22:15 - Bob Ray: <Media omitted>
[14/08/25, 12:05:09 AM] Ana: see https://x.example/a 😄
[2025-08-15, 22:12:34] Ana: iso
8.25.25, 1:00 pm – अनु: नमस्ते
16-08-2025, 11:00 - Bob Ray added Ana
tail of the notice
31/02/2025, 10:00 - Ana: rolls over
17/08/2025, 10:00 - Ana:   """


def test_parse(spark):
    folder = scratch_path(spark, "log")
    os.makedirs(folder)
    for name, text in (("a.txt", LOG), ("empty.txt", ""), ("other.txt", "no chat\nat all"), ("big.txt", "x" * 2000)):
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    files = read_exports(spark, folder)
    assert files.count() == 3  # Spark skips empty files itself
    assert {(r["file"].rsplit("/", 1)[1], r["reason"]) for r in refused_files(spark, folder, 1900).collect()} == {("big.txt", "too large")}
    rows = parse_exports(files).orderBy("id").collect()
    got = [(r["id"], r["date"], r["time"], r["sender"], r["message"]) for r in rows]
    assert got == [
        (0, "12/08/2025", "10:01", "Ana", "hello\nsecond line\nthird line"),
        (1, "13/08/2025", "22:15", "Bob Ray", "<Media omitted>"),
        (2, "14/08/2025", "00:05", "Ana", "see https://x.example/a 😄"),
        (3, "15/08/2025", "22:12", "Ana", "iso"),
        (4, "25/08/2025", "13:00", "अनु", "नमस्ते"),
        (5, "31/02/2025", "10:00", "Ana", "rolls over"),
    ]
    assert rows[1]["is_media"] and rows[2]["links"] == ["https://x.example/a"] and rows[2]["emojis"] == ["😄"]
    assert str(rows[5]["ts"]) == "2025-03-03 10:00:00"
