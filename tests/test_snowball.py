"""Stemmers on words of the published sample vocabularies, and the table of stems."""

import pytest

from lexloom.functions.snowball import STEMMERS, Endings, stem
from lexloom.operators import texts

#: Words and stems of the published samples.
SAMPLES = {
    "de": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg auferlegen auferleg auffallen auffall auffällig auffall auffälligkeiten auffall kategorie kategori kater kat katers kat katze katz kätzchen katzch "
    "kategorisch kategor kauen kau kaufen kauf kaufmann kaufmann kaum kaum kausalität kausalitat",
    "es": "cheque chequ chicas chic chicharrones chicharron chimenea chimene torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor torero torer toreros torer torio tori tornado torn tornar torn chihuahua chihuahu "
    "continuamente continu instituciones institu",
    "fr": "continu continu continua continu continuait continu continuant continu continuation continu continue continu contorsions contors contour contour contrainte contraint main main maintenaient mainten maintenant mainten maintenir mainten "
    "majestueusement majestu majestueux majestu majorité major maire mair malheureusement malheur contractés contract mal mal",
    "it": "abbandonata abbandon abbandonate abbandon abbandonò abbandon abbaruffato abbaruff abbassamento abbass abbastanza abbast abbatté abbatt pronto pront pronuncia pronunc pronunciamento pronunc propaga propag propizio propiz pronunciarle pronunc",
    "pt": "boataria boat boate boat boates boat boatos boat bob bob quilos quil química químic quilombo quilomb quilométricas quilométr quilômetro quilômetr boa boa boas boas quinta quint",
    "nl": "lichaamsziek lichaamsziek lichamelijk licham lichamelijke licham lichamen licham lichtbeelden lichtbeeld opgingen opging opglimlachten opglimlacht opheffende opheff ophield ophield lichaam licham",
    "sv": "jakt jakt jaktbössa jaktböss jakten jakt klostergården klostergård klosterheten kloster klubb klubb klokheten klok jaktkarl jaktkarl",
    "no": "havnedistrikt havnedistrikt havnedistrikter havnedistrikt opning opning opninga opning opningen opning havnedistriktets havnedistrikt",
    "da": "indtage indtag indtagelse indtag underhold underhold underholde underhold uforskammet uforskam undersøgelser undersøg",
    "ru": "важная важн важнейшие важн вагоне вагон падал пада падаль падал важнее важн пальто пальт пакостью пакост вальс вальс варенье варен",
    "en": "consign consign consigned consign consignment consign consistency consist knightly knight knackeries knackeri knotted knot generously generous",
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_samples(language):
    words = SAMPLES[language].split()
    found = {w: stem(w, language) for w in words[::2]}
    assert found == dict(zip(words[::2], words[1::2]))


@pytest.mark.parametrize("language", sorted(STEMMERS))
def test_any_word_has_a_stem(language):
    letters = "aeiouyäéèñçßœåø" + "bcdfghjklmnpqrstvwxz" + "вшись" + "'1_"
    words = ["", *letters, *(a + b for a in letters for b in letters), "é" * 60, "qu" * 40, "zzzzzz", "中文", "ieuwe", "yy", "uu"]
    for w in words:
        assert isinstance(stem(w, language), str)
    # endings go, nothing is added but what a rule names
    assert all(len(stem(w, language)) <= len(w) + 2 for w in words)


def test_longest_ending():
    table = Endings({"s": "1", "es": "2", "ares": "3"})
    assert table.longest("casares") == ("ares", "3") and table.longest("casares", 4) == ("es", "2") and table.longest("x") == ("", "") and table.longest("", 0) == ("", "")


def test_languages_by_code_or_name():
    assert stem("katzen", "German") == stem("katzen", "de") == "katz" and stem("katzen", None) == stem("katzen", "xx") == "katzen"


def test_frequencies_of_stems_of_all_languages(spark):
    rows = [(1, "en", "running", 2), (2, "en", "runs", 1), (3, "de", "katzen", 1), (3, "de", "katze", 4), (4, None, "katzen", 1), (4, "xx", "run", 1), (5, "fr", "continuait", 1), (5, "fr", "continua", 1), (6, "en", "continua", 1)]
    bags = spark.createDataFrame(rows, "doc_id bigint, lang string, term string, tf bigint")
    found = {(r["lang"], r["stem"]): r["cf"] for r in texts.stemmed_frequencies(bags, least=3).collect()}
    assert found == {("en", "run"): 3, ("de", "katz"): 5, (None, "katzen"): 1, ("xx", "run"): 1, ("fr", "continu"): 2, ("en", "continua"): 1}
