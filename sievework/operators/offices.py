"""Level and province of public offices, read from the label of the office by phrases.

A label is reduced to lower-case words between single blanks, so a phrase is found by ``contains`` and only phrases with a
gap need a pattern. The first level whose phrases (and places, where it needs one) are there decides.

Cases. Null, '' and labels that name no public office give null. A place that several provinces could claim counts only
beside a word that settles it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.scalars import known_province


class Level(NamedTuple):
    name: str
    place: str  # what else the label must name: nothing, a province, or a town
    phrases: tuple[str, ...]
    gaps: tuple[str, ...] = ()  # pairs of phrases with anything between


# Words that make a label no office held, and countries whose offices do not count.
NOT_HELD = ("former", "candidate", "voter")
EXCLUDED = ("bangladesh", "bangladeshi")
FOREIGN = ("india", "indian", "delhi", "telangana", "andhra", "maharashtra", "gujarat", "uttar pradesh", "afghanistan", "iran", "united kingdom", "london", "england")
# Provinces as labels name them.
PROVINCES = (
    "khyber pakhtunkhwa", "khyber pukhtunkhwa", "north west frontier province", "nwfp", "punjab", "sindh", "balochistan", "baluchistan", "gilgit baltistan",
    "azad jammu and kashmir", "azad jammu kashmir", "azad kashmir", "azad jammu", "ajk", "fata",
)
_BODIES = tuple(f"{area} {body}" for area in ("metropolitan", "municipal", "city", "town", "tehsil", "union", "district", "cantonment") for body in ("corporation", "council", "committee", "board"))
_JUDGES = tuple(f"{who} of the {court}" for who in ("chief justice", "justice", "judge") for court in ("supreme court", "federal shariat court", "islamabad high court"))
# Offices of each level, in the order of the tests.
LEVELS = (
    Level("National", "", ("national assembly", "senate", "senator")),
    Level(
        "Provincial", "province",
        ("provincial assembly", "legislative assembly", "chief minister", "governor of", "provincial minister", "prime minister of azad", "president of azad", "advocate general of", "minister of", "minister for"),
        ("speaker of the .*assembly",),
    ),
    Level(
        "National", "",
        (
            "president of pakistan", "prime minister of pakistan", *_JUDGES, "chief justice of pakistan", "chief of army staff", "chief of air staff", "chief of naval staff", "chief of the army staff",
            "chief of the air staff", "chief of the naval staff", "chairman joint chiefs of staff", "governor of the state bank of pakistan", "attorney general for pakistan", "attorney general of pakistan",
            "chief election commissioner", "auditor general of pakistan", "ambassador of pakistan", "high commissioner of pakistan", "federal minister", "federal secretary", "federal ombudsman",
            "minister of state", "special assistant to the prime minister",
        ),
        ("minister of .*pakistan", "minister for .*pakistan"),
    ),
    Level("Local", "town", (*_BODIES, "mayor")),
)
# Towns and districts by province, with the spellings that labels use.
TOWNS = {
    "Punjab": "lahore, faisalabad, multan, rawalpindi, gujranwala, sialkot, sargodha, bahawalpur, sahiwal, okara, kasur, sheikhupura, shaikhupura, nankana sahib, jhang, chiniot, toba tek singh, "
    "khanewal, vehari, lodhran, pakpattan, bahawalnagar, rahim yar khan, dera ghazi khan, d g khan, dg khan, muzaffargarh, layyah, rajanpur, mianwali, bhakkar, khushab, jhelum, chakwal, attock, "
    "gujrat, mandi bahauddin, hafizabad, narowal, murree, taxila, wah, lyallpur",
    "Sindh": "karachi, sukkur, sukkar, larkana, nawabshah, shaheed benazirabad, jamshoro, thatta, badin, dadu, mirpur khas, mirpurkhas, umerkot, tharparkar, tando allahyar, tando muhammad khan, "
    "matiari, sanghar, khairpur, ghotki, shikarpur, jacobabad, kashmore, kambar shahdadkot, naushahro feroze, naushehro feroze, nowshero feroze, sujawal, korangi, malir, keamari",
    "Khyber Pakhtunkhwa": "peshawar, mardan, swat, abbottabad, abbotabad, kohat, bannu, nowshera, nowshehra, charsadda, charsada, swabi, mansehra, haripur, upper dir, lower dir, chitral, buner, "
    "shangla, malakand, hangu, karak, lakki marwat, dera ismail khan, d i khan, di khan, battagram, kohistan, torghar, orakzai, kurram, mohmand, bajaur, waziristan, khyber, mingora",
    "Balochistan": "quetta, gwadar, turbat, khuzdar, sibi, zhob, loralai, chaman, pishin, kalat, mastung, nasirabad, jaffarabad, jafarabad, kharan, lasbela, lasbella, awaran, panjgur, hub",
    "Islamabad Capital Territory": "islamabad",
    "Gilgit-Baltistan": "gilgit, skardu, hunza, ghizer, diamer, astore",
    "Azad Jammu and Kashmir": "muzaffarabad, kotli, rawalakot, bhimber, neelum",
}
# Towns that are also ordinary words, and towns whose name several countries or provinces have.
WORDS_TOO = ("wah", "hub", "chaman")
SHARED = {"hyderabad": "Sindh", "mirpur": "Azad Jammu and Kashmir"}
OWN_COUNTRY = ("pakistan", "sindh", "azad jammu", "azad kashmir", "ajk")


def words(label: Column) -> Column:
    """' lower case words of a label ' with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z]+", " ")), F.lit(" "))


def says(text: Column, phrases) -> Column:
    """Whether any phrase stands in ``words`` of a text."""
    return F.exists(F.split(F.lit("|".join(phrases)), r"\|"), lambda p: text.contains(F.concat(F.lit(" "), p, F.lit(" "))))


def mentions_excluded(*texts: Column) -> Column:
    """Whether any of the texts names a country whose offices do not count."""
    return says(words(F.concat_ws(" ", *texts)), EXCLUDED)


def _first(text: Column, phrases) -> Column:
    """The phrase of the list that stands first in the text, the longer of two at one place; '' if none does."""
    return F.regexp_extract(text, " (" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + ")(?= )", 1)


def classify_position(label: Column, citizen: Column | None = None) -> Column:
    """struct(level, province) of an office; null where the label is no public office. ``citizen``: the holder is known to be a national."""
    text = words(label)
    province = _first(text, PROVINCES)
    town_of = {t: p for p, towns in TOWNS.items() for t in towns.split(", ")}
    beside = "|".join(f"(?: {t}) (?:{'|'.join(_BODIES)}) | (?:{'|'.join(_BODIES)})(?: of| in| for)?(?: the)? (?:{t}) " for t in WORDS_TOO)
    plain = _first(text, [t for t in town_of if t not in WORDS_TOO])
    wordy = F.when(says(text, OWN_COUNTRY) | text.rlike(beside), _first(text, WORDS_TOO)).otherwise("")
    shared = _first(text, SHARED)
    settled = says(text, OWN_COUNTRY) | ((shared == "hyderabad") & ~says(text, ("greater",)) & (F.lit(False) if citizen is None else F.coalesce(citizen, F.lit(False))))
    town = F.when(plain != "", plain).when(wordy != "", wordy).when((shared != "") & settled, shared).otherwise("")
    places = F.create_map(*[F.lit(x) for pair in (town_of | SHARED).items() for x in pair])
    where = {"": F.lit(""), "province": F.coalesce(known_province(province), province), "town": F.try_element_at(places, town)}
    has = {"": F.lit(True), "province": province != "", "town": (town != "") & ~says(text, FOREIGN)}
    out = F.when((text == "  ") | says(text, (*NOT_HELD, *EXCLUDED)), None)
    for level in LEVELS:
        named = says(text, level.phrases)
        for gap in level.gaps:
            named = named | text.rlike(f" {gap} ")
        out = out.when(named & has[level.place], F.struct(F.lit(level.name).alias("level"), where[level.place].alias("province")))
    return out
