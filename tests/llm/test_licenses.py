import random

from metertide.llm.licenses import NAMING, TEMPLATES, align, longest_ascending, scan_licenses
from tests.llm import samples


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_ascending_subsequence():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(50):
        values = [rng.randrange(20) for _ in range(8)]
        places = longest_ascending(values)
        chosen = [values[p] for p in places]
        assert places == sorted(places) and chosen == sorted(set(chosen))
        longest = max(
            (n for n in range(9) for c in combinations(values, n) if list(c) == sorted(set(c))), default=0
        )
        assert len(places) == longest


def test_matches_ascend_and_join_equal_words():
    rng = random.Random(2)
    words = TEMPLATES["MIT-notice"].lower().split()
    for _ in range(30):
        text = [w for w in words if rng.random() > 0.1]
        for _ in range(6):
            text.insert(rng.randrange(len(text)), rng.choice(words))
        pairs = align(words, text)
        assert all(words[i] == text[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert longest_common(words, text) >= len(pairs) >= 0.85 * longest_common(words, text)
    assert align(words, words) == [(i, i) for i in range(len(words)) if (i, i) in align(words, words)]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in scan_licenses(docs).collect()}


def test_every_notice_is_found_where_it_stands(spark):
    rng = random.Random(3)
    before = samples.prose(rng, "en", 500)
    texts = [f"{before}\n{text}\n{samples.prose(rng, 'de', 300)}" for text in TEMPLATES.values()]
    found = scanned(spark, texts)
    for i, name in enumerate(TEMPLATES):
        row = found[i]
        assert row["license"] == name
        assert row["coverage"] > 0.9
        words = texts[i].split()
        assert words[row["first_word"]] == TEMPLATES[name].split()[0]
        assert row["last_word"] - row["first_word"] + 1 == len(TEMPLATES[name].split())


def test_changed_repeated_and_missing_notices(spark):
    rng = random.Random(4)
    plain = samples.prose(rng, "en", 400)
    notice = TEMPLATES["GPL-3.0-notice"].split()
    changed = " ".join(w for i, w in enumerate(notice) if i % 12)
    line = TEMPLATES["MIT"]
    texts = [
        plain + " " + changed,
        "\n".join([line, plain] * 3),
        f"{line}\n" * 500,
        plain,
        " ".join(notice[::2]),
        "released " + plain + " under the MIT license",
        "/* RELEASED under the mit license */",
    ]
    found = scanned(spark, texts)
    assert found[0]["license"] == "GPL-3.0-notice" and 0.8 <= found[0]["coverage"] < 1
    assert found[1]["license"] == found[2]["license"] == "MIT"
    assert found[3]["license"] is None and found[3]["coverage"] == 0
    assert found[4]["license"] != "GPL-3.0-notice"
    assert found[5]["license"] in (None, "MIT")
    assert found[6]["license"] == "MIT"


def test_two_licenses_of_one_text(spark):
    text = TEMPLATES["Apache-2.0"] + " words between " + TEMPLATES["CC-BY-NC-4.0"]
    row = scanned(spark, [text])[0]
    assert {f["license"] for f in row["found"]} == {"Apache-2.0", "CC-BY-NC-4.0"}
    assert row["license"] == "Apache-2.0"


def test_odd_rows_and_empty_tables(spark):
    docs = samples.documents(spark)
    found = scan_licenses(docs).collect()
    assert len(found) == len(samples.rows())
    assert {r["license"] for r in found} == {None}
    assert scan_licenses(samples.empty(spark)).count() == 0


def test_licenses_that_are_no_templates_take_no_neighbours_name(spark):
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    bsd = TEMPLATES["BSD-3-Clause"].replace("copyright holder", "University")
    cases = {
        "Released under the BSD License.": "BSD",
        "Released under the GPL License.": None,
        "Released under the Apache License.": None,
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY-NC 3.0.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under the Apache License v2": "Apache-2.0",
        gnu.format("", "2"): "GPL-2.0",
        gnu.format("", "3.0"): "GPL-3.0",
        gnu.format("", "1"): None,
        gnu.format("Lesser ", "3"): "LGPL-3.0",
        gnu.format("Affero ", "3"): "AGPL-3.0",
        gnu.format("Affero ", "1"): None,
        TEMPLATES["GPL-3.0-notice"].replace("General", "Library General"): None,
        bsd: "BSD-3-Clause",
        TEMPLATES["MIT-notice"] + " The Software shall be used for Good, not Evil.": None,
        "Released under the BSD License. Released under MIT License.": "BSD",
        "Released under the GPL License. Released under MIT License.": "MIT",
    }
    found = scanned(spark, list(cases))
    assert {t: found[i]["license"] for i, t in enumerate(cases)} == cases


def test_every_naming_word_is_in_its_template():
    for name, rule in NAMING.items():
        text = TEMPLATES[name].lower()
        assert all(word in text for word in rule.words)
        assert not any(word in text for word in rule.without)


def test_edited_notices_that_repeat_or_have_stray_words_are_found(spark):
    cases = [
        ("Released under MIT License. Released under MIT License. See the file.", "MIT"),
        ("Released in 2020 by the well known authors of it, licensed under the MIT License.", "MIT"),
    ]
    notice = TEMPLATES["ISC"].split()
    for i, word in enumerate(notice):
        if notice.count(word) == 1:
            edited = " ".join(notice[:i] + notice[i + 1 :])
            cases.append((f"{edited}\n{edited}\nIt says {word}", "ISC"))
    # A stray first word, and no room for a block without it.
    cases.append(("permission " + "x " * 60 + " ".join(notice[2:]), "ISC"))
    found = scanned(spark, [t for t, _ in cases])
    assert [found[i]["license"] for i in range(len(cases))] == [name for _, name in cases]
