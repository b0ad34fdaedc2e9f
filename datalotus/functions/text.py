"""Cell-level text expressions for Thai and mixed-language columns.

All are built-in Spark expressions, so they stay in generated code and work alike
in batch and streaming. Java's regex classes are ASCII unless `(?U)` is set;
where Unicode classes are meant, it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI_DIGITS, ARABIC_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
ZERO_WIDTH = "​‌‍﻿⁠"
THAI_LETTER = "[ก-ฺเ-๎]"
THAI_CONSONANT = "[ก-ฮ]"
COMBINING = "[ัิ-ฺ็-๎]"
TONE = "[่-๋]"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]"
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "nan", "none", "null", "nil", "unknown", "missing", "tbd", "ไม่ระบุ", "ไม่มี", "ไม่ทราบ", ".")
SPACE = "(?U)\\s"


def strip(c: Column) -> Column:
    """Trim any Unicode white space (Spark's own trim knows U+0020 only)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def script_ratio(c: Column) -> dict[str, Column]:
    """Shares of a cell's characters by script; emoji first."""
    n = F.length(c).cast("double")
    share = lambda pattern: F.when(n > 0, F.regexp_count(c, F.lit(pattern)) / n).otherwise(0.0)
    parts = {"thai": share("[฀-๏๚-๿]"), "latin": share("[A-Za-z]"), "digit": share("[0-9]"), "thai_digit": share(f"[{THAI_DIGITS}]"), "whitespace": share(SPACE), "emoji": share(EMOJI)}
    rest = F.lit(1.0)
    for x in parts.values():
        rest = rest - x
    return {**parts, "other": F.when(n > 0, F.greatest(rest, F.lit(0.0))).otherwise(0.0)}


def _content_ratio(c: Column, pattern: str) -> Column:
    solid = F.length(F.regexp_replace(c, SPACE, "")).cast("double")
    return F.when(solid > 0, F.regexp_count(c, F.lit(pattern)) / solid).otherwise(0.0)


def thai_content_ratio(c: Column) -> Column:
    return _content_ratio(c, "[฀-๏๚-๿]")


def latin_content_ratio(c: Column) -> Column:
    return _content_ratio(c, "[A-Za-z]")


def thai_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(THAI_CONSONANT))


def latin_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def arabic_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, ARABIC_DIGITS)


def has_thai_digits(c: Column) -> Column:
    return c.rlike(f"[{THAI_DIGITS}]")


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def has_zero_width(c: Column) -> Column:
    return c.rlike(f"[{ZERO_WIDTH}]")


def squeeze(c: Column) -> Column:
    """No-break space to space, runs of spaces to one, ends trimmed."""
    return strip(F.regexp_replace(F.translate(c, " ", " "), " {2,}", " "))


def has_odd_space(c: Column) -> Column:
    return (strip(c) != c) | c.contains("  ") | c.contains(" ")


def clean_phone(c: Column) -> Column:
    bare = F.regexp_replace(arabic_digits(c), "[-(). \\s]", "")
    local = F.regexp_replace(bare, "^\\+66", "0")
    return F.when(local.rlike("^[689][0-9]{8}$"), F.concat(F.lit("0"), local)).otherwise(local)


def is_phone(c: Column) -> Column:
    return clean_phone(c).rlike("^0[0-9]{9}$")


def normalize_phone(c: Column) -> Column:
    return F.when(is_phone(c), clean_phone(c)).otherwise(c)


def valid_citizen_id(c: Column) -> Column:
    """13 digits whose last is the check digit; null is invalid."""
    bare = F.regexp_replace(c.cast("string"), "[\\s-]", "")
    total = F.lit(0)
    for i in range(12):
        total = total + F.when(bare.rlike("^[0-9]{13}$"), F.substring(bare, i + 1, 1)).otherwise("0").cast("int") * (13 - i)
    check = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(10))
    return F.coalesce(bare.rlike("^[0-9]{13}$") & (check.cast("string") == F.substring(bare, 13, 1)), F.lit(False))


def is_number(c: Column) -> Column:
    """What a lenient numeric parser accepts; rejects suffixes such as 12d."""
    return F.coalesce(c.rlike("^\\s*[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?|inf|Infinity)\\s*$"), F.lit(False))


def to_number(c: Column) -> Column:
    return F.when(is_number(c), F.regexp_replace(c, "\\s", "").try_cast("double"))


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(*PLACEHOLDERS)


def repeated_char_spam(c: Column) -> Column:
    """Runs of three: digits only if 5; letters need four; other signs three."""
    return c.rlike("(?U)5{3,}") | c.rlike("(?U)(\\p{L})\\1{3,}") | c.rlike("(?U)([^\\p{L}\\p{Nd}\\s])\\1{2,}")


def combining_order_issue(c: Column) -> Column:
    return c.rlike(f"(?<![ก-๎]){COMBINING}")


def tone_stacked(c: Column) -> Column:
    return c.rlike(f"({TONE})\\1+")


def several_tones(c: Column) -> Column:
    return c.rlike(f"{TONE}{{2,}}")


def fix_tone_stacking(c: Column) -> Column:
    return F.regexp_replace(c, f"({TONE})\\1+", "$1")


def duplicated_vowel(c: Column) -> Column:
    return c.rlike("([ัิ-ู])\\1")


def has_fullwidth(c: Column) -> Column:
    return c.rlike("[！-～]")


def fold_fullwidth(c: Column) -> Column:
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    return F.translate(c, wide, "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)))


def cap_repeats(c: Column, most: int = 3) -> Column:
    """Letter runs are cut to `most`; the repetition mark to one."""
    return F.regexp_replace(F.regexp_replace(c, "ๆ{2,}", "ๆ"), f"(?U)(\\p{{L}})\\1{{{most},}}", "$1" * most)


def keyboard_suspect(c: Column) -> Column:
    latin, thai = latin_count(c), F.regexp_count(c, F.lit(THAI_LETTER))
    return (latin >= 3) & (latin > thai)


_KEYS = "1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:\"ZXCVBNM<>?"
_THAI_KEYS = "ๅ/-ภถุึคตจขชๆไำพะัีรนยบลฃฟหกดเ้่าสวงผปแอิืทมใฝ+๑๒๓๔ู฿๕๖๗๘๙๐\"ฎฑธํ๊ณฯญฐ,ฅฤฆฏโฌ็๋ษศซ.()ฉฮฺ์?ฒฬฦ"


def retype_thai(c: Column) -> Column:
    """What the same keys give on a Kedmanee keyboard."""
    return F.translate(c, _KEYS, _THAI_KEYS)


def mojibake_kind(c: Column) -> Column:
    """'latin-1' for UTF-8 read as Latin-1, 'cp874' for UTF-8 read as Thai, else null."""
    hits = F.regexp_count(c, F.lit("เธ|เน"))
    return F.when(c.rlike("à[¸¹]"), "latin-1").when((hits >= 3) & (hits * 2 >= F.length(c) * 0.4), "cp874")


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1 where the result has Thai."""
    narrow = c.rlike("à[¸¹]") & c.rlike("^[\\x00-\\xff]*$")
    back = F.try_validate_utf8(F.encode(F.when(narrow, c), "ISO-8859-1").cast("string"))
    return F.coalesce(F.when(back.rlike(THAI_CONSONANT), back), c)


def control_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f�]"))


def long_repetition(c: Column) -> Column:
    return c.rlike("(.)\\1{4,}")


def date_signature(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "9")


def buddhist_year(c: Column) -> Column:
    """A year of the Buddhist era in the cell (2440 to 2599), as int."""
    return F.nullif(F.regexp_extract(arabic_digits(c.cast("string")), "(?<![0-9])(24[4-9][0-9]|25[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")


def to_common_era(c: Column) -> Column:
    """Buddhist years in a text (24xx and 25xx) less 543."""
    years = F.regexp_extract_all(c, F.lit("(?<![0-9])(2[45][0-9]{2})(?![0-9])"), F.lit(1))
    pieces = F.split(c, "(?<![0-9])2[45][0-9]{2}(?![0-9])", -1)
    new = F.concat(F.transform(years, lambda y: (y.cast("int") - 543).cast("string")), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, new, lambda p, y: F.concat(p, y)), "")


THAI_MONTHS = {
    1: ("มกราคม", "ม.ค."), 2: ("กุมภาพันธ์", "ก.พ."), 3: ("มีนาคม", "มี.ค."), 4: ("เมษายน", "เม.ย."), 5: ("พฤษภาคม", "พ.ค."), 6: ("มิถุนายน", "มิ.ย."),
    7: ("กรกฎาคม", "ก.ค."), 8: ("สิงหาคม", "ส.ค."), 9: ("กันยายน", "ก.ย."), 10: ("ตุลาคม", "ต.ค."), 11: ("พฤศจิกายน", "พ.ย."), 12: ("ธันวาคม", "ธ.ค."),
}


def normalize_date(c: Column) -> Column:
    """Thai month names to dd/mm/yyyy, four-digit Buddhist years to common era."""
    out = arabic_digits(c)
    for number, names in THAI_MONTHS.items():
        for name in names:
            out = F.regexp_replace(out, f"([0-9]{{1,2}})\\s*{name.replace('.', chr(92) + '.')}\\s*([0-9]{{4}}|[0-9]{{2}})", f"$1/{number:02d}/$2")
    return to_common_era(out)


DATE = "^\\s*([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}([ T].*)?|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{4}|[0-9]{2})([ T].*)?)\\s*$"


def is_date_like(c: Column) -> Column:
    return arabic_digits(c).rlike(DATE) | c.rlike("(?i)(มกราคม|กุมภาพันธ์|มีนาคม|เมษายน|พฤษภาคม|มิถุนายน|กรกฎาคม|สิงหาคม|กันยายน|ตุลาคม|พฤศจิกายน|ธันวาคม)")


CURRENCY = "(?i)(฿|\\$|€|£|¥|บาท|thb|usd|eur|gbp|jpy|baht)"


def money(c: Column) -> Column:
    """The amount of a cell such as '฿1,200.50' or '300 บาท'."""
    bare = F.regexp_replace(F.regexp_replace(arabic_digits(c), CURRENCY, ""), "[,\\s]", "")
    return F.when(bare.rlike("^[+-]?[0-9]+(\\.[0-9]+)?$"), bare.cast("double"))


def id_likeness(c: Column) -> Column:
    """Mean of seven tests for code-like cells."""
    n = F.length(c).cast("double")
    tests = [
        F.regexp_count(c, F.lit("[0-9]")) >= 0.3 * n,
        F.regexp_count(c, F.lit("[A-Z]")) > 0.5 * n,
        c.rlike("[A-Za-z0-9][-_/.][A-Za-z0-9]"),
        n <= 20,
        ~c.contains(" "),
        c.rlike("[A-Za-z]") & c.rlike("[0-9]"),
        F.size(F.array_distinct(F.split(c, ""))) < 0.85 * n,
    ]
    total = F.lit(0.0)
    for t in tests:
        total = total + F.coalesce(t, F.lit(False)).cast("double")
    return F.when(n > 0, total / 7).otherwise(0.0)


def normalize_key(c: Column) -> Column:
    """A key's comparable form: Arabic digits, no zero-width signs, no '.0'."""
    return F.regexp_replace(strip(strip_zero_width(arabic_digits(c.cast("string")))), "^(-?[0-9]+)\\.0+$", "$1")


PROVINCES = ("กรุงเทพมหานคร", "กรุงเทพ", "เชียงใหม่", "เชียงราย", "ขอนแก่น", "นครราชสีมา", "ชลบุรี", "ภูเก็ต", "สงขลา", "นนทบุรี", "ปทุมธานี", "สมุทรปราการ", "อุดรธานี", "ระยอง", "นครปฐม", "อยุธยา", "สุราษฎร์ธานี", "ลำปาง", "พิษณุโลก", "อุบลราชธานี")


def parse_address(c: Column) -> Column:
    """Struct of house_no, moo, subdistrict, district, province, postal_code."""
    text = arabic_digits(c)
    # the last five digits that stand alone: before them, a house number may have five digits too
    code = "(?<![0-9])(?<![0-9]/)([1-9][0-9]{4})(?!/?[0-9])"
    postal = F.regexp_extract(text, f"(?s)^.*{code}", 1)
    bare = F.regexp_replace(text, f"(?s)^(.*){code}", "$1")
    part = lambda pattern: F.nullif(F.regexp_extract(bare, pattern, 1), F.lit(""))
    named = part("(?:จังหวัด|จ\\.)\\s*([ก-๎]+)")
    return F.struct(
        part("(?:เลขที่|บ้านเลขที่)?\\s*([0-9]+(?:/[0-9]+)?)").alias("house_no"), part("(?:หมู่ที่|หมู่|ม\\.)\\s*([0-9]+)").alias("moo"),
        part("(?:ตำบล|ต\\.|แขวง)\\s*([ก-๎]+)").alias("subdistrict"), part("(?:อำเภอ|อ\\.|เขต)\\s*([ก-๎]+)").alias("district"),
        F.coalesce(named, part(f"({'|'.join(PROVINCES)})")).alias("province"), F.nullif(postal, F.lit("")).alias("postal_code"),
    )


HOLIDAYS = {(1, 1): "New Year's Day", (4, 6): "Chakri Day", (4, 13): "Songkran", (4, 14): "Songkran", (4, 15): "Songkran", (5, 1): "Labour Day", (5, 4): "Coronation Day", (6, 3): "Queen's Birthday", (7, 28): "King's Birthday", (8, 12): "Mother's Day", (10, 13): "King Bhumibol Memorial Day", (10, 23): "Chulalongkorn Day", (12, 5): "Father's Day", (12, 10): "Constitution Day", (12, 31): "New Year's Eve"}


def holiday_name(d: Column, weekends: bool = True) -> Column:
    """Fixed holidays first, then Saturday and Sunday, else ''."""
    out = F.lit("")
    if weekends:
        out = F.when(F.dayofweek(d) == 7, "Saturday").when(F.dayofweek(d) == 1, "Sunday").otherwise("")
    days = F.create_map(*[F.lit(x) for (m, n), name in HOLIDAYS.items() for x in (m * 100 + n, name)])
    return F.coalesce(F.element_at(days, F.month(d) * 100 + F.dayofmonth(d)), out)


def is_holiday(d: Column, weekends: bool = True) -> Column:
    return holiday_name(d, weekends) != ""


def visible(c: Column) -> Column:
    """A cell with its zero-width signs made visible."""
    out = c
    for sign in ZERO_WIDTH:
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out
