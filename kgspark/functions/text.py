"""Text and id columns: accents, ids, prefixes, labels, units."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Id prefixes, the longest first, with the form the curation step uses.
PREFIXES = {
    "TRIEU_CHUNG_": "S_",
    "BAI_THUOC_": "BT_",
    "HOAT_CHAT_": "HC_",
    "CONG_NANG_": "CN_",
    "VI_THUOC_": "VI_THUOC_",
    "DUOC_LY_": "DL_",
    "BENH_LY_": "B_",
    "BENH_": "B_",
    "VT_": "VI_THUOC_",
    "BT_": "BT_",
    "HC_": "HC_",
    "DL_": "DL_",
    "CN_": "CN_",
    "NB_": "NB_",
    "B_": "B_",
    "S_": "S_",
    "T_": "T_",
    "V_": "V_",
    "K_": "K_",
}
#: The prefixes that the curation step itself tells apart, with the form it uses; the others stay.
CURATED = {"VI_THUOC_": "VI_THUOC_", "BAI_THUOC_": "BT_", "TRIEU_CHUNG_": "S_", "BENH_LY_": "B_", "BENH_": "B_", "THUOC_": "THUOC_", "NHOMBENH_": "NHOMBENH_", "BT_": "BT_", "VT_": "VI_THUOC_", "CN_": "CN_", "HC_": "HC_", "DL_": "DL_", "B_": "B_", "S_": "S_", "T_": "T_", "V_": "V_", "K_": "K_", "G_": "G_"}
#: Node label of each prefix.
LABELS = {"VI_THUOC_": "ViThuoc", "VT_": "ViThuoc", "BT_": "BaiThuoc", "HC_": "HoatChat", "DL_": "DuocLy", "CN_": "CongNang", "NB_": "NhomBenh", "B_": "Benh", "S_": "TrieuChung", "T_": "TinhVi", "V_": "TinhVi", "K_": "KinhMach"}
#: Tastes, natures and meridians, and attribute ids that say nothing.
TASTES = ("CAY", "TAN", "CHUA", "TOAN", "DANG", "KHO", "DANG_KHO", "NGOT", "CAM", "MAN", "HAM", "NHAT", "DAM", "CHAT")
NATURES = ("HAN", "NHIET", "ON", "LUONG", "BINH", "AM", "LANH", "DAI_NHIET", "DAI_ON", "HOI_HAN", "HOI_ON", "VI_ON", "VI_HAN", "TRUNG_TINH")
MERIDIANS = ("TAM", "CAN", "TY", "PHE", "THAN", "DOM", "DAN", "VI", "DAI_TRANG", "TIEU_TRANG", "BANG_QUANG", "TAM_BAO", "TAM_TIEU")
EMPTY_ATTRIBUTES = ("T_KHONG_DOC", "V_KHONG_DOC", "T_AN_THAN", "V_AN_THAN", "T_KY_TU", "V_KY_TU", "T_THAO_QUA", "V_THAO_QUA", "T_HOAT", "V_HOAT", "T_TINH", "V_VI", "T_DUONG", "V_DUONG", "T_CO_TINH", "V_CO_VI")
#: Words around an attribute's core, in the order they are taken off; mixed values and the one that stays.
WORDY = ("VI_CO_TINH_", "VI_TINH_", "CO_TINH_", "TINH_", "VI_CO_VI_", "CO_VI_", "VI_VI_")
MIXED = {"CAY_DANG": "CAY", "TAN_KHO": "TAN", "CAY_ON": "ON", "TAN_ON": "ON"}
UNITS = {"gam": "g", "gram": "g", "grams": "g", "kilogam": "kg", "kilogram": "kg", "mililit": "ml"}


def _combining() -> str:
    """All combining marks as a regex class of ranges."""
    runs: list[list[int]] = []
    for c in range(0x300, sys.maxunicode + 1):
        if unicodedata.combining(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


_MARKS = _combining()


@F.arrow_udf(StringType())
def strip_accents(s: pa.Array) -> pa.Array:
    """đ and Đ to d and D, then compatibility decomposition without combining marks. Whole Arrow arrays; ASCII passes as it is.

    Only the texts of a batch that aren't ASCII are worked on, each different one once.
    """
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(s)), False)
    if not pc.any(odd).as_py():
        return s
    texts = s.filter(odd).dictionary_encode()
    plain = pc.replace_substring(pc.replace_substring(texts.dictionary, "đ", "d"), "Đ", "D")
    plain = pc.replace_substring_regex(pc.utf8_normalize(plain, form="NFKD"), _MARKS, "")
    return pc.replace_with_mask(s, odd, plain.take(texts.indices))


def normalize_plain_id(text: Column) -> Column:
    """An id of text without accents: other characters than letters, digits and _ become _, upper case, no doubled or outer _."""
    out = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9_]", "_"))
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    return F.when(out == "", "UNKNOWN").otherwise(out)


def normalize_id(text: Column) -> Column:
    return normalize_plain_id(strip_accents(text))


def hub_id_from_name(name: Column, prefix: str = "VI_THUOC_") -> Column:
    """Hub id of a display name: a leading word for the type goes."""
    core = F.regexp_replace(F.trim(name), r"(?iu)^(cây|vị thuốc|thuốc)\s+", "")
    return F.concat(F.lit(prefix), normalize_id(core))


def _prefix_case(id_: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for p in sorted(values, key=len):  # the longest ends up outermost
        out = F.when(id_.startswith(p), F.lit(values[p])).otherwise(out)
    return out


def label_from_prefix(id_: Column, default: str = "ThucThe") -> Column:
    return _prefix_case(id_, LABELS, F.lit(default))


def id_prefix(id_: Column) -> Column:
    """The known prefix, else the first part with its _, else UNKNOWN_."""
    head = F.regexp_extract(F.coalesce(id_, F.lit("")), "^([^_]+_)", 1)
    return _prefix_case(id_, {p: p for p in PREFIXES}, F.when(head == "", "UNKNOWN_").otherwise(head))


def id_core(id_: Column, prefixes: Iterable[str] = tuple(PREFIXES)) -> Column:
    """The id without a known prefix."""
    p = "|".join(sorted(prefixes, key=len, reverse=True))
    return F.regexp_replace(id_, f"^({p})", "")


def name_from_id(id_: Column) -> Column:
    """Words of the core with capitals, split at _."""
    return F.initcap(F.lower(F.replace(id_core(id_), F.lit("_"), F.lit(" "))))


def normalize_prefix(id_: Column, target: str | Column | None = None, synonyms: dict[str, str] | None = None) -> Column:
    """Upper-case id without accents and with its prefix in the curation form, or the target prefix; synonyms apply to the core.

    A column as target may be null or empty: then the id keeps its own prefix. An empty or null id gives an empty one.
    """
    up = strip_accents(F.upper(F.trim(F.coalesce(id_, F.lit("")))))
    # One match and a lookup: a chain of cases, which each later column holds again, grows into code that isn't compiled.
    head = F.regexp_extract(up, "^(" + "|".join(sorted(CURATED, key=len, reverse=True)) + ")", 1)
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CURATED.items() for x in pair]), head), F.lit(""))
    core = F.when(head == "", up).otherwise(F.regexp_replace(up.substr(F.length(head) + 1, F.length(up)), "^_+|_+$", ""))
    if synonyms:
        core = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]), core), core)
    wanted = own if target is None else F.when(F.coalesce(F.lit(target) if isinstance(target, str) else target, F.lit("")) == "", own).otherwise(target)
    return F.when(up == "", "").otherwise(F.regexp_replace(F.concat(wanted, core), "^_+|_+$", ""))


def link_id(id_: Column, fallback: str = "VT_") -> Column:
    """The linker's form: herbs as VT_, remedies as BT_, a fallback prefix if there is none."""
    up = F.upper(F.trim(id_))
    known = _prefix_case(up, PREFIXES | {"VI_THUOC_": "VT_", "VT_": "VT_"}, F.lit(fallback))
    return F.concat(known, F.regexp_replace(id_core(up), "^_+|_+$", ""))


def clean_attribute_id(id_: Column) -> Column:
    """Repaired nature, taste or meridian id; null if it says nothing.

    In order: upper case; doubled prefix; ids that say nothing; wordy cores; a lone VI_ that is no meridian; stutter within the
    core; mixed values; then the prefix that the core belongs to, for a meridian the longest one in the id.
    """
    up = F.replace(F.upper(F.trim(id_)), F.lit(" "), F.lit("_"))
    up = F.regexp_replace(up, "^([TVK]_)\\1", "$1")
    core = up
    for words in WORDY:
        core = F.regexp_replace(F.regexp_replace(core, f"^([TVK]_){words}", "$1"), f"^{words}", "")
    core = F.regexp_replace(core, "^(?!K_)([TV]_)?VI_", "$1")
    core = F.regexp_replace(core, "^([TVK]_)?(.+)_\\2$", "$1$2")
    for mixed, single in MIXED.items():
        core = F.replace(core, F.lit(mixed), F.lit(single))

    def judged(c: Column) -> Column:
        bare = F.regexp_replace(c, "^[TVK]_", "")
        # Longest first, and anywhere: the leftmost match may be a short one.
        meridian = F.coalesce(*[F.when(c.contains(m), F.lit(f"K_{m}")) for m in sorted(MERIDIANS, key=lambda m: (-len(m), m))], c)
        return F.when(bare.isin("", "UNKNOWN"), F.lit(None).cast("string")).when(bare.isin(*TASTES), F.concat(F.lit("V_"), bare)).when(bare.isin(*NATURES), F.concat(F.lit("T_"), bare)).when(c.startswith("K_"), meridian).otherwise(c)

    # The long chain above is worked out once: a lambda over a one-element array holds it.
    known = F.when(up.isin("", *EMPTY_ATTRIBUTES), F.lit(None).cast("string")).otherwise(core)
    return F.element_at(F.transform(F.array(known), judged), 1)


def clean_text(text: Column) -> Column:
    """Line ends, real or written out, become blanks; runs of white space shrink; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\r\n|\n|\r|\\n", " "), r"\s{2,}", " "))


def strip_null_words(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?i)^(null|none)\s+", ""), r"(?i)\snull\s", " ")


def wrap_units(text: Column, units: dict[str, str] | None = None) -> Column:
    """One spelling for unit words, and number and unit as $10g$ unless that is done."""
    units = UNITS if units is None else units
    one = reduce(lambda c, kv: F.regexp_replace(c, rf"(?iU)(?<=\d)\s*{kv[0]}\b", kv[1]), sorted(units.items(), key=lambda kv: -len(kv[0])), text)
    short = "|".join(sorted({*units.values()}, key=len, reverse=True))
    return F.regexp_replace(one, rf"(?U)(?<![\$\w.,])(\d+(?:[.,]\d+)?)\s*({short})\b(?!\$)", r"\$$1$2\$")


def clean_entity_name(name: Column) -> Column:
    """Without tags and words for types, blanks squeezed, first letter large."""
    out = F.regexp_replace(F.regexp_replace(name, "<[^>]*>", " "), r"(?iu)^\s*(vị thuốc|bài thuốc|cây|bệnh)\s+", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1_000_000))
