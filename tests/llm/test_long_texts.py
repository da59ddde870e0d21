"""Very long texts, ties and repeated rows, where the other tests have short ones."""

import random
import zlib
from collections import Counter, defaultdict

from ledgerlight.llm import linededup, sharding, wrapper

SCHEMA = "doc_id long, text string"


def test_line_dedup_of_a_very_long_text(spark):
    r = random.Random(5)
    base = "".join(f"Line {i} of {r.randrange(9)}.\n" for i in range(30000))
    rows = [(1, base), (2, f"head.\n{base}tail.\n"), (3, None), (4, "")]
    got = {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: base, 2: "head.\ntail.\n", 3: None, 4: ""}


def test_sharding_of_equal_sizes_and_one_very_long_text(spark):
    rows = [(i, f"{i % 10} same size") for i in range(400)] + [(7, "7 same size")] * 3 + [(1000, "é" * 1_000_000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=4, slots=64).collect()
    want = Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == want
    places, load = defaultdict(list), Counter()
    for x in got:
        places[x.shard].append(x.slot)
        load[x.shard] += x.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # The long text fills one shard alone; the others share what is left nearly equally.
    rest = sorted(load.values())[:-1]
    assert len(rest) == 3 and max(rest) < 1.1 * min(rest)


def test_wrapper_of_a_very_long_page():
    body = [f"Paragraph {i} &amp; more." for i in range(20000)]
    page = "<html><body><nav>Menu</nav><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer>Foot</footer></body></html>"
    assert wrapper.main_text(page) == "\n\n".join(b.replace("&amp;", "&") for b in body)
    deep = "<div>" * 5000 + "<p>inside</p>" + "</div>" * 5000
    assert wrapper.main_text(f"<html><body><article>{deep}</article></body></html>") == "inside"
