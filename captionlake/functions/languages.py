"""Languages by code and by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language names by code.
NAMES = dict(
    x.split(":")
    for x in """en:english zh:chinese de:german es:spanish ru:russian ko:korean fr:french ja:japanese pt:portuguese tr:turkish pl:polish ca:catalan
    nl:dutch ar:arabic sv:swedish it:italian id:indonesian hi:hindi fi:finnish vi:vietnamese he:hebrew uk:ukrainian el:greek ms:malay cs:czech
    ro:romanian da:danish hu:hungarian ta:tamil no:norwegian th:thai ur:urdu hr:croatian bg:bulgarian lt:lithuanian la:latin mi:maori ml:malayalam
    cy:welsh sk:slovak te:telugu fa:persian lv:latvian bn:bengali sr:serbian az:azerbaijani sl:slovenian kn:kannada et:estonian mk:macedonian
    br:breton eu:basque is:icelandic hy:armenian ne:nepali mn:mongolian bs:bosnian kk:kazakh sq:albanian sw:swahili gl:galician mr:marathi
    pa:punjabi si:sinhala km:khmer sn:shona yo:yoruba so:somali af:afrikaans oc:occitan ka:georgian be:belarusian tg:tajik sd:sindhi gu:gujarati
    am:amharic yi:yiddish lo:lao uz:uzbek fo:faroese ps:pashto tk:turkmen nn:nynorsk mt:maltese sa:sanskrit lb:luxembourgish my:myanmar bo:tibetan
    tl:tagalog mg:malagasy as:assamese tt:tatar haw:hawaiian ln:lingala ha:hausa ba:bashkir jw:javanese su:sundanese yue:cantonese""".split()
) | {"ht": "haitian creole"}
#: Other names of languages.
ALIASES = {
    "burmese": "my", "valencian": "ca", "flemish": "nl", "haitian": "ht", "letzeburgesch": "lb", "pushto": "ps", "panjabi": "pa",
    "moldavian": "ro", "moldovan": "ro", "sinhalese": "si", "castilian": "es",
}
#: Languages whose words are not set apart by blanks.
UNSPACED = ("ja", "zh", "yue")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def code(language: Column) -> Column:
    """The code of a code, a name or another name in any case; null for none of them."""
    low = F.lower(F.trim(language))
    return F.coalesce(F.when(low.isin(*NAMES), low), _map({name: c for c, name in NAMES.items()} | ALIASES)[low])


def long_name(language: Column) -> Column:
    """The name of a code, else what is given; the first letter large and the others small."""
    name = F.coalesce(_map(NAMES)[language], language)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))


def spaced(language: Column) -> Column:
    """Whether words are set apart by blanks; a language that is not known counts as one where they are."""
    return ~F.coalesce(code(language), F.lit("")).isin(*UNSPACED)
