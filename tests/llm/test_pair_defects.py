import pytest
from pyspark.sql import functions as F

from quire.llm.pair_defects import defect_of, ends_inside, has_words, is_copy, is_empty, language_share, open_at_end, pair_defects, runs, tiles

EN = "The abbess supported the manuscript of the second volume. The register lists 12 entries, yet nobody read it."
ZH = "女修道院长支持了第二卷的手稿。登记簿列有12个条目，然而无人阅读。"


@pytest.mark.parametrize(
    "source,response,wanted,defect",
    [
        (EN, ZH, "zh", None),
        (EN, None, "zh", "empty"),
        (EN, " \u200b\n", "zh", "empty"),
        (EN, "[译文]", "zh", "empty"),
        (EN, "N/A", "zh", "empty"),
        (EN, "女修道院长支持了第二", "zh", "truncated"),
        (EN, ZH[:-1] + "，而", "zh", "truncated"),
        (EN, "抱歉，我无法翻译这段内容。", "zh", "refusal"),
        (EN, "女修道院长支持了手稿。 I'm sorry, but I can't translate this passage.", "zh", "refusal"),
        (EN, EN.upper(), "zh", "copy"),
        (EN, "Translation: " + EN, "zh", "copy"),
        (EN, EN + "\n" + EN, "de", "copy"),
        (EN, "Die Äbtissin unterstützte das Manuskript des zweiten Bandes, und das Register nennt 12 Einträge.", "zh", "wrong_language"),
        (EN, "La abadesa apoyó el manuscrito del segundo volumen y los registros de la villa.", "fr", "wrong_language"),
        (EN, "修道院の長は長い冬のあとで手稿を支持した。", "zh", "wrong_language"),
        (EN, ZH + " 2 * 3 * 4 = 24", "zh", None),
        (EN, ZH + " C:\\plates\\ii", "zh", None),
        (EN, "“这封信我帮不了你。”她回答道，尽管登记簿列有12个条目，而女修道院长支持了手稿。", "zh", None),
        ("https://archive.example/f/1", "https://archive.example/f/1", "zh", None),
        ("[^fn-1-2]", "[^fn-1-2]", "zh", None),
        (None, None, None, "empty"),
        (None, ZH, "zh", None),
        (EN, ZH, None, None),
    ],
)
def test_defects(source, response, wanted, defect):
    assert defect_of(source, response, wanted, None) == defect


def test_parts():
    assert tiles("a b c d e f".split(), "x a b c y d e f".split()) == 6
    assert is_copy("a b c d e", "A  B c, d e!") and not is_copy("a b c d e f g", "q r s t")
    assert open_at_end("（见X “a”") == ["（"] and open_at_end("<ul><li>x</li></ul>") == [] and open_at_end("```\nx") == ["```"]
    assert ends_inside("He went to the") and not ends_inside("He went home.") and not ends_inside("他回家了。[^fn-1-2]")
    assert not has_words("https://x.example/y [^fn-0-1] 12") and has_words("a word")
    assert is_empty("…") and not is_empty("x1")
    assert language_share(ZH, "zh") > 0.9 and language_share("12", "zh") is None
    assert not is_copy("x " * 50_000, "y " * 50_000)


def test_frame(spark):
    rows = [("k", EN, ZH, "zh", "d")] * 3 + [("n", None, None, None, "d"), ("e", EN, "", "zh", "d")]
    df = spark.createDataFrame(rows, "key string, source_text string, translated_text string, target_lang string, defect string")
    got = pair_defects(df)
    assert got.columns == df.columns
    assert sorted((r.key, str(r.defect)) for r in got.collect()) == [("e", "empty"), ("k", "None"), ("k", "None"), ("k", "None"), ("n", "empty")]
    assert got.count() == 5 and pair_defects(df.limit(0)).count() == 0
    many = spark.createDataFrame([("k", EN * 4, ZH * 4, "zh", "")] * 30 + [("short", EN * 4, ZH[:15], "zh", "")], df.schema)
    assert [r.key for r in pair_defects(many).where(F.col("defect") == "truncated").collect()] == ["short"]


def test_copies_of_any_number_and_length():
    source = "The old harbour was closed to every ship before the winter came."
    assert all(is_copy(source, " ".join([source] * n)) for n in (1, 4, 6, 12, 300))
    long = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(41_000)]
    assert not is_copy(" ".join(long), " ".join(long[::-1])) and is_copy(" ".join(long), " ".join(long[:20_000] + ["other"] + long[20_000:]))
    assert is_copy("Old Harbour", "Old Harbour. Old Harbour.") and not is_copy("Old Harbour", "Harbour Old")
    words = long[:60]
    assert runs(words, words[30:] + ["x"] + words[:30], 1) == tiles(words, words[30:] + ["x"] + words[:30]) == 60 and runs(words, words[:5] * 3, 2) == 10


def test_text_after_many_marks_is_not_empty():
    assert not is_empty("." * 300 + " Der Hafen war geschlossen.") and is_empty("." * 300)


def test_copy_where_only_the_script_tells():
    names = "Heinrich Tulquajor, Wenjaslod Hovxeryel, Kamvos Dunyel, Rinpal Sutundwim"
    assert language_share(names, "en") >= 0.75 and defect_of(names, names, "en", 1.0) == "copy" and defect_of(names, names + " Orvlen", "en", 1.0) == "copy"
    assert defect_of(EN, EN, "en", 1.0) == "copy" and defect_of(ZH, ZH, "zh", 1.0) == "copy"
    assert defect_of(EN, ZH, "zh", 1.0) is None


def test_shuffled_words_are_no_copy_at_any_length():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(15_000)] * 3
    mixed = words[::7] + words[1::7] + words[2::7] + words[3::7] + words[4::7] + words[5::7] + words[6::7]
    assert not is_copy(" ".join(words[:1000]), " ".join(mixed[:1000])) and not is_copy(" ".join(words), " ".join(mixed))


def test_near_copy_in_the_wanted_language_is_a_copy():
    de = "Der Hafen war im Winter geschlossen, und die Schiffe lagen vor der Stadt. Niemand hat das Register gelesen."
    assert defect_of(de, de, "de", 1.0) == "copy" and defect_of(de, de.replace("Niemand", "Keiner"), "de", 1.0) == "copy"


def test_any_depth_of_brackets():
    assert open_at_end("( [ 《 { text )") == [] and open_at_end("( ) [ 《 { text") == ["[", "《", "{"]
    assert open_at_end("(" * 50_000 + "]" * 50_000 + ")" * 49_999) == ["("]


def test_sentence_end_far_from_the_end():
    assert ends_inside("Er ging. " + "und weiter " * 200) and not ends_inside("| 12 | 14 " * 300)


def test_refusal_only_where_the_source_does_not_say_it():
    said = "He said: I cannot translate this letter. The register lists 12 entries."
    assert defect_of(said, "他说：我无法翻译这封信。登记簿列有12个条目。", "zh", 1.0) is None
    assert defect_of(said, "他说：我无法翻译这封信。登记簿列有12个条目。抱歉，我无法翻译这段内容。", "zh", 1.0) == "refusal"
    assert defect_of(EN, "I cannot translate this letter.", "zh", 1.0) == "refusal"


def test_language_without_function_words_is_not_judged():
    assert defect_of(EN, "Abbedissan stödde den andra volymens manuskript, men ingen läste registret.", "sv", 1.0) is None
    assert defect_of(EN, "Opatka poparła rękopis drugiego tomu, ale nikt nie czytał rejestru.", "pl", 1.0) is None
    assert language_share("यह एक पुराना बंदरगाह है", "hi") == 1.0 and language_share(EN, "hi") == 0.0
