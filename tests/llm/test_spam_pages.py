import random
import re
from collections import Counter, defaultdict
from time import process_time
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sortament.llm import spam_pages as spam
from sortament.llm.spam_pages import Lists, learn_lists, page_features, score_pages, spam_pages
from sortament.operators.units import SPELLINGS, UNIT
from tests.conftest import rows

random.seed(7)
PROSE = (
    "После резки остаётся обрезок, и его можно забрать на складе. Мы сравнили три предложения, но цена у них не изменилась. "
    "Если нужен размер, лучше спросить остаток заранее. На бирке видно, что номер не совпал со счётом. "
)
ENGLISH = "The yard shows a long bar and it is not for sale. We had the material sent back because of the dents. Has anybody seen this before the winter? "
GERMAN = "Wir haben drei Angebote verglichen, aber der Preis blieb gleich. Nach dem Schneiden bleibt ein Rest, den man abholen kann. Das Lager meldet morgen neue Mengen. "
SMALL = {
    "ru": "и на но не у мы их его если что как или до после по при из потому когда кто бы ещё уже только под между во чем они",
    "en": "the a an is was and of to its by not but if has we this that with at from on it as after before because there no had for",
    "de": "der die das ein eine und in den mit auf bei nach dem den man aber der nicht für aus ohne an vor ist war noch",
}
LETTERS = {"ru": ("бвгдзклмнпрст", "аеиоу"), "en": ("bcdfgklmnprst", "aeiou"), "de": ("bcdfgklmnprstw", "aeiou")}


def corpus(lang, size=80):
    """Texts of sentences of made-up nouns, each after a function word."""
    pick = random.Random(lang)
    noun = lambda: "".join(pick.choice(LETTERS[lang][0]) + pick.choice(LETTERS[lang][1]) for _ in range(3)) + pick.choice(LETTERS[lang][0])
    nouns, small = [noun() for _ in range(300)], SMALL[lang].split()
    sentence = lambda: " ".join(f"{pick.choice(small)} {pick.choice(nouns)}" for _ in range(pick.randint(3, 5))).capitalize() + "."
    return [(" ".join(sentence() for _ in range(pick.randint(4, 8))), lang) for _ in range(size)]


BACKGROUND = corpus("ru") + corpus("en") + [(PROSE, "ru")] * 8 + [(ENGLISH, None)] * 8
TAGS = "Теги: " + ", ".join(f"{w}{random.randrange(99)}" for w in random.choices(["труба", "цена", "лист", "кг", "за", "в", "с"], k=60))
SPAM = {
    "keywords": "\n".join(random.choices(["купить трубу оптом", "цена лист с доставкой", "круг в розницу"], k=40)),
    "sentences": " ".join(w.capitalize() + "." for w in random.choices(["купить трубу оптом со склада", "цена лист с доставкой сегодня"], k=40)),
    "tags": TAGS,
    "hashes": " ".join(f"#{w}" for w in random.choices(["труба", "цена", "где", "от", "с"], k=60)),
    "links": "\n".join(f'<a href="https://stal.example/p{i}/tag{i}">купить трубу дёшево</a>' for i in range(20)),
    "markdown": " | ".join(f"[прайс трубу](https://stal.example/p{i})" for i in range(20)),
    "urls": " ".join(f"https://stal.example/list{i}/p{i}" for i in range(30)),
    "products": " • ".join(f"лист {n}ХФ{n % 9}Д{n}" for n in range(10, 60)),
    "after": PROSE + "\n" + "\n".join(random.choices(["купить трубу оптом", "цена лист сегодня"], k=80)),
    "navigation": "Продажа лист Ольшанский перейти » Цена плиту в розницу перейти » Круг дёшево сегодня перейти » " * 12,
    "english": "\n".join(random.choices(["buy pipe today", "cheap sheet per kilo", "near me bar stock"], k=40)),
}
CLEAN = {
    "prose": PROSE * 3,
    "prose_en": ENGLISH * 3,
    "footer": PROSE * 4 + "\n" + TAGS[:60],
    "prices": "Прайс-лист на текущую неделю, цены указаны за килограмм.\n" + "\n".join(f"{i}) труба 5{i}х{i},5х5300 мм г/к — 8 9{i} кг, 1 9{i}2 руб." for i in range(20)),
    "glossary": "\n".join(f"MB-{i}0231-K — {s}." for i, s in enumerate(PROSE.split(". ")[:4] * 4)),
    "thread": "\n".join("> " * d + s for d in (1, 2, 1) for s in PROSE.split(". ")),
    "inline_links": PROSE + "см. https://stal.example/p1 " + PROSE,
    "same_subject": "Труба не лежит на складе, но трубу мы ждём. Если труба придёт, мы её взвесим и скажем цену трубы. " * 3,
    "empty": "",
}


@pytest.fixture(scope="module")
def docs(spark):
    texts = {**SPAM, **CLEAN}
    data = [(i, t, "x", 1.0) for i, t in enumerate(texts.values())]
    around = [(1000 + i, t, lang, 1.0) for i, (t, lang) in enumerate(BACKGROUND)]
    return spark.createDataFrame([*data, *around, (900, None, "x", 1.0), (None, TAGS, "x", 1.0)], "doc_id long, text string, lang string, rate double"), list(texts)


def test_cases(spark, docs):
    df, names = docs
    assert sorted(names[r.doc_id] for r in spam_pages(df).collect()) == sorted(SPAM)


def test_repeated_rows_and_empty_tables(spark, docs):
    df, _ = docs
    assert rows(spam_pages(df.unionByName(df))) == rows(spam_pages(df))
    assert spam_pages(df.where("false")).count() == 0
    assert score_pages(df).count() == len(SPAM) + len(CLEAN) + len(BACKGROUND)
    assert score_pages(df.drop("lang")).count() == len(SPAM) + len(CLEAN) + len(BACKGROUND)


def test_function_words_are_learned(spark):
    df = spark.createDataFrame([*corpus("ru"), *corpus("en"), *corpus("de"), *[("купить трубу оптом с доставкой", "ru")] * 50], "text string, code string")
    lists = learn_lists(df)
    assert {"the", "has"} <= lists.functions["en"] and {"der"} <= lists.functions["de"] and not {"купить", "доставкой"} & lists.functions["ru"]
    assert {"купить", "трубу"} <= lists.listed["ru"]
    assert lists.common == {"cyrillic": "ru", "latin": max(("en", "de"), key=lambda c: learn_total(df, c))}
    assert lists.language("обрезок на складе", "en") == "ru" and lists.language("bar", "de") == "de" and lists.language("bar", None) in ("en", "de")
    assert learn_lists(df.where("false")) == Lists({}, {}, {}, {})


def learn_total(df, code):
    """Words without digits in well-formed sentences, which here are all."""
    return df.where(F.col("code") == code).select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]


NONE = Lists({}, {}, {}, {})


def test_long_texts_are_read_whole():
    long_text = PROSE * 30 + "\n" + SPAM["keywords"] * 200
    lang, n, links, by_bin, *_ = page_features(long_text, None, NONE)
    assert lang == "cyrillic" and n > 20_000 and sum(by_bin[:2]) > 0.9 * n


def test_long_addresses_are_links():
    text = "\n".join(f"[лист](https://stal.example/{'p' * 2_500}{i})" for i in range(3))
    _, n, links, *_ = page_features(text, None, NONE)
    assert n == links == 3 * 5
    nested = "[" * 50_000 + "<a " * 50_000 + "](" * 50_000  # must not be read again and again
    assert page_features(nested, None, NONE)[1] == 50_000


def test_words_are_counted_once():
    for text in [*SPAM.values(), *CLEAN.values()]:
        _, n, links, by_bin, price_words, plain, *_ = page_features(text, None, NONE)
        assert links + sum(by_bin) + price_words + plain == n


def _more(spark, texts, around=BACKGROUND):
    data = [(i, t, lang) for i, (t, lang) in enumerate([*texts.values(), *around])]
    found = spam_pages(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    return sorted([*texts, *["background"] * len(around)][r.doc_id] for r in found.collect())


def test_shares_take_part_where_phrases_hold_function_words(spark):
    towns = ["Ольшанский", "Лужанск", "Тихоборье", "Приветлужск"]
    links = [f"{w} {k} {t} в каталог" for w in ("труба", "лист", "круг", "шина") for k in ("дёшево", "оптом", "цена") for t in towns]
    random.shuffle(links)
    sentences = PROSE.strip().split(". ")
    texts = {
        "navigation": (" | ".join(links), "ru"),
        "lines": ("\n".join(x.capitalize() for x in links), None),
        "thread": ("\n".join("> " * d + s.rstrip(".") + "." for d in (0, 1, 2, 3) for s in sentences), "ru"),
        "forum": (PROSE + "\n" + "\n".join([sentences[0] + "."] * 6), "ru"),
        "chat": (PROSE.lower().replace(". ", "\n"), "ru"),
        "quoted": (ENGLISH * 2, "ru"),
        **{f"prose{i}": (" ".join(random.sample(PROSE.replace(". ", ".|").split("|"), 5)), "ru") for i in range(20)},
    }
    assert _more(spark, texts) == ["lines", "navigation"]


def test_a_third_language_is_learned(spark):
    """Spam and sentences in a language that no part of the code names."""
    phrases = ["rohr günstig kaufen", "blech preis heute", "stahl rohr angebot", "stab im shop"]
    texts = {
        "keywords": ("\n".join(random.choices(phrases, k=40)), "de"),
        "list": (", ".join(random.choices(phrases, k=60)), "deu"),
        "tags": (" ".join(f"#{w}" for w in random.choices(["rohr", "preis", "kaufen", "blech"], k=60)), "DE"),
        "links": ("\n".join(f"[rohr kaufen](https://stahl.example/p{i})" for i in range(20)), "de-AT"),
        "prose": (GERMAN * 2, "ger"),
        "notes": ("\n".join(t.replace(". ", "\n") for t, _ in corpus("de", 2)), "de"),
        "lower": (corpus("de", 3)[2][0].lower(), "de"),
        **{f"prose{i}": (GERMAN, "de") for i in range(5)},
    }
    assert _more(spark, texts, BACKGROUND + corpus("de", 60)) == ["keywords", "links", "list", "tags"]


def test_languages_with_too_few_sentences(spark):
    texts = {
        "keywords": (" ".join(random.choices(["rohr kaufen", "blech preis", "stahl rohr"], k=60)), "de"),
        "prose": (GERMAN * 2, "de"),
        "notes": (GERMAN.replace(". ", "\n"), "de"),
        "english": (SPAM["english"], "en"),
        "wrong": (ENGLISH, "ru"),
        **{f"prose{i}": (GERMAN, "de") for i in range(5)},
    }
    assert _more(spark, texts) == ["english", "keywords"]


# The plain patterns that the quick ones stand for.
PLAIN_WORD = re.compile(r"[^\W_]+")
PLAIN_UNITS = re.compile(r"([.!?…»]+(?=\s+\D|\s*$)|\s[|•]\s)")
PLAIN_NUMBER = re.compile(r"(?<![\w.,])\d+(?:[.,'\s]\d+)*(?!\w)")
PLAIN_AMOUNT = re.compile(rf"\d\s*(?:{UNIT}|руб|₽|р\.|\$|€|usd|eur|rub)(?!\w)|(?<!\w)(?:{UNIT})\.?\s*[—–:)-]", re.I)


def test_quick_patterns_find_what_plain_ones_find():
    signs = "".join(map(chr, (*range(0xD800), *range(0xE000, 1 << 16))))
    for text in (signs, *map("-".join, zip(signs)), "𝒜𝒷 x_1 😀²"):
        assert spam._WORDS[spam._BEYOND.search(text) is not None](text) == PLAIN_WORD.findall(text)
    pick = random.Random(3)
    spellings = [w for ws in SPELLINGS.values() for w in ws]
    bits = [*".!?…»|•,;:#/()«\"—–-_'> \n\t\r", " — ", " | ", ". ", ".» ", "шт.", " руб", "5 ₽", "$", "1 912", "24,06", "K", "ſ", "İ", "<a b>c</A>", "[a](b)", "HTTPſ://x", "foo.bK/x", *spellings]
    amounts = 0
    for _ in range(20_000):
        text = "".join(pick.choice(bits) if pick.random() < 0.7 else str(pick.randrange(99)) for _ in range(pick.choice((3, 8, 14))))
        amounts += bool(PLAIN_AMOUNT.search(text))
        assert bool(spam._NUMBER_UNIT.search(text) or spam._UNIT_NUMBER.search(text)) == bool(PLAIN_AMOUNT.search(text)), text
        assert spam._NUMBER.findall(text) == PLAIN_NUMBER.findall(text), text
        assert spam._MAY_LINK.search(text) or not spam._LINK.search(text), text
        assert spam._units_of(text)(text) == PLAIN_UNITS.split(text), text
    assert 2_000 < amounts < 18_000
    for w in spellings:
        assert spam._NUMBER_UNIT.search(f"5 {w}") and spam._UNIT_NUMBER.search(f"{w} — 5"), w


def test_repeated_triples_and_separators():
    def features(text):
        return page_features(text, "x", Lists({"x": frozenset({"in"})}, {"x": frozenset({"listed"})}, {"latin": "x"}, {"x": "latin"}))

    _, n, *_, separators, top, repeated, _, hits, _, varied, _ = features("A b c a b c a b. D a b c d, in listed; In steel in, steel in copper.")
    words = "a b c a b c a b d a b c d in listed in steel in steel in copper".split()
    triples = Counter(zip(words, words[1:], words[2:]))
    assert (n, separators, top) == (len(words), 3, 4 / len(words))
    assert repeated == sum(c for c in triples.values() if c > 1) / sum(triples.values())
    assert (hits, varied) == (2, 2)  # before a listed word or a comma one says nothing
    assert features("One two")[9] == features("")[9] == 0.0


def test_words_in_sentences_are_counted_with_what_follows():
    texts = ["Один два три четыре. Один пять два три! один шесть | Семь один два три.", None, "Один 7 семь x1 два.", "𝒜𝒷 один."]
    codes = ["ru", "ru", "en", None]
    read = [(c, t) for c, t in zip(codes, texts) if t is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in read]), pa.array([t for _, t in read])], ["code", "text"])
    inside, every, then = Counter(), Counter(), defaultdict(set)
    for code, text in read:
        pieces = [*PLAIN_UNITS.split(text), ""]
        for unit, mark in zip(pieces[::2], pieces[1::2]):
            words = PLAIN_WORD.findall(unit.lower())
            every.update((code, w) for w in words)
            if spam._formed(unit, len(words), mark):
                inside.update((code, w) for w in words)
                for w, after in zip(words, words[1:]):
                    then[code, w].add(crc32(after.encode()) & 63)
    found = {(r["code"], r["word"]): (r["inside"], r["n"], r["contexts"] & (2**64 - 1)) for b in spam._count_words(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()}
    assert found == {k: (inside[k], n, sum(1 << place for place in then[k])) for k, n in every.items() if k[1].isalpha()}


def test_cost_by_that_of_finding_words():
    """CPU time of both passes, by that of a plain search for the same words."""

    def seconds(f):
        def once():
            begun = process_time()
            f()
            return process_time() - begun

        return min(once() for _ in range(7))

    def words(pages):
        return seconds(lambda: [PLAIN_WORD.findall(t.lower()) for t in pages])

    lists = ["\n".join(f"{i}) труба 5{i}х{i},5х5300 — остаток — 8 9{i}, 1 9{i}2" for i in range(40))] * 50
    assert seconds(lambda: [page_features(t, "ru", NONE) for t in lists]) < 14 * words(lists)  # 21 by a search for amounts from every sign
    pages = [t for t, _ in BACKGROUND] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(["ru"] * len(pages)), pa.array(pages)], ["code", "text"])
    assert seconds(lambda: list(spam._count_words(iter([batch])))) < 3.3 * words(pages)  # 4 with pairs of words in sets
