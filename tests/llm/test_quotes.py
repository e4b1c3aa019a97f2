"""Quotes of a few words are no sentences; longer ones are."""

from lattica.llm.sentences import is_end, tokens


def words(text):
    return [t for t in tokens(text) if not is_end(t)]


def test_only_quotes_of_a_few_words_are_left_out():
    assert words('The "old oak bow" hangs here.') == ["the", "hangs", "here"]
    assert words("Er nennt «温暖的火把» schön.") == ["er", "nennt", "schön"]
    assert words('He saw "Bow_Oak/a.json Armor_Iron/b.json one two three" there.') == ["he", "saw", "there"]
    for quote in ('"%s"', "«%s»", "“%s”", "„%s“"):
        assert words(quote % "This whole line is quoted.") == ["this", "whole", "line", "is", "quoted"]
    assert words("«这是一个完整的中文句子»") == list("这是一个完整的中文句子")
    assert words('A 6" plank of old wood lies beside the 8" one.')[1:-1] == "plank of old wood lies beside the".split()


def test_a_long_quote_is_a_sentence_of_its_own():
    got = tokens('She said "der alte Mann geht nach Hause" and left.')
    at = got.index("der")
    assert is_end(got[at - 1]) and is_end(got[at + 6]) and got[at:at + 6] == "der alte mann geht nach hause".split()
