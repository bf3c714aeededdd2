"""A Markdown and a JSON corpus composed from ``documents``, and a glossary for it.

The same SQL text composes it in Spark and in other engines.
"""

from __future__ import annotations

from ..sources.glossary import Glossary

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    return "concat(" + ", ".join(x for p in parts for x in (p, _NL)) + ")"


_ID = "CAST(doc_id AS STRING)"
_WORD = "CASE lang WHEN 'fr' THEN 'eau' WHEN 'de' THEN 'der' WHEN 'es' THEN 'que' ELSE 'the' END"
_FRONT = f"CASE WHEN doc_id % 5 <> 0 THEN {_lines(repr('---'), f'concat({chr(39)}title: doc {chr(39)}, {_ID})', f'concat({chr(39)}lang: {chr(39)}, lang)', repr('---'))} ELSE '' END"
FENCE = f"concat('```sql', {_NL}, 'select {{w}} from t', {_NL}, '```')".replace("'select {w} from t'", f"concat('select ', {_WORD}, ' from t')")
INLINE = f"concat(chr(96), {_WORD}, chr(96))"
_BODY = (
    f"concat('# Doc ', {_ID}, {_NL}, '## Intro', {_NL}, "
    f"CASE WHEN doc_id % 3 = 0 THEN concat({FENCE}, {_NL}) ELSE '' END, "
    f"CASE WHEN doc_id % 4 = 0 THEN concat('Code ', {INLINE}, ' here.', {_NL}) ELSE '' END, "
    f"CASE WHEN doc_id % 2 = 0 THEN concat('See https://x.example/', {_WORD}, ' and [a](./', {_WORD}, '.md) urn:x:', {_WORD}, ' end', {_NL}) ELSE '' END, "
    f"CASE WHEN doc_id % 7 = 0 THEN concat({_WORD}, '-cli api_', {_WORD}, '.md ', {_WORD}, ' alone', {_NL}) ELSE '' END, "
    f"CASE WHEN doc_id % 6 = 0 THEN concat('| a | b |', {_NL}, '| - | - |', {_NL}, '| 1 | ', {_WORD}, ' |', {_NL}) ELSE '' END, "
    f"'## Body', {_NL}, text)"
)
#: Markdown of a document, LF line ends; and with CRLF in some.
MARKDOWN_LF = f"concat({_FRONT}, {_BODY})"
MARKDOWN = f"CASE WHEN doc_id % 11 = 0 THEN replace({MARKDOWN_LF}, chr(10), concat(chr(13), chr(10))) ELSE {MARKDOWN_LF} END"
FRONT, BODY = _FRONT, _BODY
JSON = f"""concat('{{"id":', {_ID}, ',"lang":"', lang, '","nav":{{"title":"', {_WORD}, ' one","items":["plain", "say ', {_WORD}, ' now", 3, null, true]}},"link":"https://x.example/', {_WORD}, '","source":"', source, '"}}')"""
PATH = f"concat('docs/', lang, '/', source, '/d', {_ID}, '.md')"

GLOSSARY = Glossary(
    ["en", "fr", "de", "es"],
    [
        {"canonical": "article", "type": "word", "translations": {"en": "then", "fr": "eaux", "de": "der"}, "do_not_use": {"en": ["the"], "fr": ["eau"], "de": ["der"]}},
        {"canonical": "suffix", "type": "word", "translations": {"en": "ering", "fr": ""}, "do_not_use": {"en": ["ing"]}},
        {"canonical": "and", "type": "word", "translations": {}, "do_not_use": {"en": ["and"], "fr": ["les"], "es": ["que"]}},
        {"canonical": "plain", "type": "word", "translations": {"en": "plain", "fr": "plain", "de": "plain", "es": "plain"}},
    ],
)
