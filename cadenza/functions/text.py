"""Scalar functions on transcripts, words and phones, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Vowels of the ARPAbet (fixed values).
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
EDGE = r"[\p{P}\p{S}\p{Z}]+"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose(text: Column) -> Column:
    """NFC; only texts beyond ASCII leave the JVM's expressions."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_composed(text))


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_edges(word: Column) -> Column:
    """Without punctuation, symbols and separators at either end; inner ones stay."""
    return F.regexp_replace(word, f"^{EDGE}|{EDGE}$", "")


def normalise(text: Column) -> Column:
    """Lower case, composed, edges of every word stripped, empty words dropped, single spaces."""
    # Over the whole text at once: runs of edge characters after white space, then those before it.
    edge = r"[\p{P}\p{S}\p{Z}&&[^\s]]"
    bare = F.regexp_replace(F.lower(compose(text)), rf"(?<!\S){edge}++|(?<!{edge}){edge}++(?!\S)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\s+", " ")


def strip_markers(text: Column) -> Column:
    """Without a leading <s> and a trailing </s>, also where nothing else is there."""
    bare = F.regexp_replace(strip(text), r"^<s>(?:\s+|$)", "")
    return F.regexp_replace(bare, r"(?:^|\s+)</s>$", "")


def base_word(word: Column) -> Column:
    """word of word(n)."""
    return F.regexp_replace(word, r"\(\d+\)$", "")


def variant(word: Column) -> Column:
    """n of word(n); 1 without a suffix."""
    return F.coalesce(F.nullif(F.regexp_extract(word, r"\((\d+)\)$", 1), F.lit("")).cast("int"), F.lit(1))


def strip_stress(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\d+$", "")


def stress(phone: Column) -> Column:
    """The trailing number, or null."""
    return F.nullif(F.regexp_extract(phone, r"(\d+)$", 1), F.lit("")).cast("int")


def is_vowel(phone: Column) -> Column:
    return strip_stress(phone).isin(*VOWELS)


def stressed_vowels(phones: Column) -> Column:
    """vowel and level (-1 without) of every vowel of a pronunciation."""
    vowels = F.filter(phones, is_vowel)
    return F.transform(vowels, lambda p: F.struct(strip_stress(p).alias("vowel"), F.coalesce(stress(p), F.lit(-1)).alias("level")))


def primary_stress(phones: Column) -> Column:
    """Index from 0, among the vowels, of the first of level 1; null if there is none."""
    at = F.array_position(F.transform(stressed_vowels(phones), lambda v: v["level"]), 1)
    return F.when(at > 0, at - 1)


def map_phones(phones: Column, mapping: Column) -> Column:
    """Phones through a map to arrays: renamed, expanded or deleted; phones without an entry pass."""
    return F.flatten(F.transform(phones, lambda p: F.coalesce(F.element_at(mapping, p), F.array(p))))


def escape_textgrid(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def format_of(text: Column) -> Column:
    """sphinx, tsv, csv or unknown, of a whole file: its first line that is neither blank nor a comment (#) decides."""
    line = strip(F.regexp_extract(text, r"(?m)^[^\S\n]*([^\s#][^\n]*)", 1))
    sphinx = line.startswith("<s>") & line.contains("</s>")
    return F.when(sphinx, "sphinx").when(line.contains("\t"), "tsv").when(line.contains(","), "csv").otherwise("unknown")


def utterance(line: Column) -> Column:
    """utt_id and text: white space and a trailing (id), sentence marks dropped; else the first word is the id.

    Ids in brackets may hold spaces; a bracket that ends a word, as in read(2), is no id. Null for blank
    lines and for lines of one word without an id.
    """
    bare = strip(line)
    form = r"(?s)^(.*?)\s+\(([^)]+)\)$"
    tail, body = F.regexp_extract(bare, form, 2), strip_markers(F.regexp_extract(bare, form, 1))
    lead, rest = F.regexp_extract(bare, r"(?s)^(\S+)\s+(.*)$", 1), F.regexp_extract(bare, r"(?s)^(\S+)\s+(.*)$", 2)
    return F.when(tail != "", F.struct(tail.alias("utt_id"), body.alias("text"))).when(
        lead != "", F.struct(lead.alias("utt_id"), rest.alias("text"))
    )


def unsafe_id(utt_id: Column) -> Column:
    """Ids that can't be file names: empty, absolute, with backslash, dot parts or a .wav suffix."""
    return (utt_id == "") | utt_id.rlike(r"\\|^/|(^|/)\.\.?(/|$)|\.wav$")


def decoder_utterance(line: Column) -> Column:
    """utt_id and text of the lenient form: the last bracket is the id, sentence marks stay; null without one past the begin."""
    bare = strip(F.make_valid_utf8(line))
    form = r"(?s)^(.+)\(([^()]*)\)[^()]*$"
    start = F.length(F.regexp_extract(bare, form, 1))
    part = F.struct(strip(F.regexp_extract(bare, form, 2)).alias("utt_id"), strip(F.regexp_extract(bare, form, 1)).alias("text"))
    return F.when(start > 0, part)


def normalise_line(line: Column) -> Column:
    """line and changed: transcript lines with marks and id have their text normalised, all others stay, stripped."""
    bare = strip(line)
    form = r"^<s>\s+(.*?)\s+</s>\s+\(([^)]+)\)"
    marked = bare.rlike(form) & ~bare.startswith("#")
    built = F.concat(F.lit("<s> "), normalise(F.regexp_extract(bare, form, 1)), F.lit(" </s> ("), F.regexp_extract(bare, form, 2), F.lit(")"))
    return F.struct(F.when(marked, built).otherwise(bare).alias("line"), F.coalesce(marked, F.lit(False)).alias("changed"))


def csv_fields(line: Column) -> Column:
    """The fields of a line of comma-separated values: quotes hold commas and doubled quotes; what follows a closing quote belongs to the field."""
    quoted = r"\"(?:[^\"]|\"\")*+"
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf"(?s),({quoted}(?:\"[^,]*+|$)|[^,]*+)"), F.lit(1))
    inner = lambda f: F.regexp_replace(F.regexp_extract(f, rf"(?s)^({quoted})", 1).substr(F.lit(2), F.length(f)), '""', '"')
    rest = lambda f: F.regexp_extract(f, rf"(?s)^{quoted}\"(.*)$", 1)
    return F.transform(fields, lambda f: F.when(f.startswith('"'), F.concat(inner(f), rest(f))).otherwise(f))


def to_sphinx(line: Column, form: Column) -> Column:
    """A transcript line of a form (sphinx, tsv, csv) as <s> text </s> (id); null for lines that hold none.

    csv: the first field is the id, all others, joined by commas again, the text; fields may be quoted.
    """
    bare = strip(line)
    tab, fields = F.split(bare, "\t", 2), csv_fields(line)
    built = lambda i, t: F.concat(F.lit("<s> "), strip(t), F.lit(" </s> ("), strip(i), F.lit(")"))
    name, text = F.get(fields, F.lit(0)), F.array_join(F.slice(fields, 2, 1 << 30), ",")
    there = (bare != "") & ~bare.startswith("#")
    return (
        F.when((form == "sphinx") & there & bare.rlike(r"^<s>\s+.*\s+</s>\s+\([^)]+\)"), bare)
        .when((form == "tsv") & there & (F.size(tab) == 2), built(F.get(tab, F.lit(0)), F.get(tab, F.lit(1))))
        .when((form == "csv") & (strip(name) != "") & (strip(text) != ""), built(name, text))
    )


def prompt_text(text: Column) -> Column:
    """Upper case; anything but letters, digits, _ and inner apostrophes becomes a single space."""
    kept = F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}_\s']", " ")
    return F.array_join(words(F.regexp_replace(F.regexp_replace(kept, r"\s+'|'\s+", " "), "^'|'$", "")), " ")


def stress_map(vowels: Column, marks: Column) -> Column:
    """vowel with each mark to vowel."""
    return F.map_from_entries(F.flatten(F.transform(vowels, lambda v: F.transform(marks, lambda m: F.struct(F.concat(v, m), v)))))


def has_variant_suffix(word: Column) -> Column:
    """Whether a word ends in a number in brackets, after at least one character."""
    return word.rlike(r"^.+\([0-9]+\)$")


def clean_transcript(text: Column) -> Column:
    """Without blanks, tabs and line ends at either end."""
    return F.regexp_replace(text, r"^[ \t\n]+|[ \t\n\r]+$", "")
