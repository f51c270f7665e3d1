"""Spreadsheet number formats: sections, conditions, dates, fractions, percent and scientific notation."""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The format codes of built-in numbers.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()

_PART = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|General|[yY]+|[mM]+|[dD]+|[hH]+|[sS]+(?:\.0+)?|.', re.S)


def general(value: float) -> str:
    """Up to 15 significant digits without trailing zeros."""
    if not math.isfinite(value):
        return str(value)
    if value == int(value) and abs(value) < 1e11:
        return str(int(value))
    return f"{value:.15g}" if abs(value) < 1e15 else f"{value:.5E}"


def _sections(code: str) -> list[str]:
    return [s for s in re.findall(r'((?:"[^"]*"|\\.|\[[^\]]*\]|[^;])*)(?:;|$)', code)][:4]


def _choose(value: float, sections: list[str]) -> tuple[str, float]:
    tests = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "=": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b}
    for s in sections[:3]:
        if m := re.match(r"(?:\[[^\]<>=]*\])*\[(<=|>=|<>|<|>|=)(-?[\d.]+)\]", s):
            if tests[m[1]](value, float(m[2])):
                return s, abs(value) if value < 0 else value
    sections = [s for s in sections if s] or ["General"]
    if value < 0 and len(sections) > 1:
        return sections[1], -value
    if value == 0 and len(sections) > 2:
        return sections[2], value
    return sections[0], value


def _date(value: float, parts: list[str], date1904: bool) -> str:
    if not 0 <= value < 2_958_466:  # the last day is in the year 9999
        return "#####"
    day = int(value)
    seconds = Decimal(repr(value - day)) * 86400
    tenths = any(p.lower().startswith("s") and "." in p for p in parts)
    whole = int(seconds.quantize(Decimal("0.1") if tenths else Decimal(1), ROUND_HALF_UP))
    if whole >= 86400:
        day, whole = day + 1, 0
    base = dt.date(1904, 1, 1) if date1904 else dt.date(1899, 12, 31)
    date = base + dt.timedelta(days=day - 1 if not date1904 and day > 60 else day)
    h, mi, s = whole // 3600, whole % 3600 // 60, whole % 60
    half = any(p in ("AM/PM", "A/P") for p in parts)
    out, after_hour = [], False
    for k, p in enumerate(parts):
        q = p.lower()
        if q[0] == "[" and q.strip("[]") in ("h", "hh", "m", "mm", "s", "ss"):
            total = day * 86400 + whole
            out.append(str({"h": total // 3600, "m": total // 60, "s": total}[q[1]]).zfill(len(q) - 2))
            after_hour = q[1] == "h"
        elif q[0] == "y":
            out.append(f"{date.year:04}" if len(q) > 2 else f"{date.year % 100:02}")
        elif q[0] == "m" and q.strip("m") == "":
            nxt = next((x.lower() for x in parts[k + 1 :] if x[0].isalpha()), "")
            if len(q) < 3 and (after_hour or nxt.startswith("s")):
                out.append(f"{mi:0{len(q)}}")
            else:
                name = MONTHS[date.month - 1]
                out.append({1: str(date.month), 2: f"{date.month:02}", 3: name[:3], 5: name[0]}.get(len(q), name))
            after_hour = False
        elif q[0] == "d":
            out.append({1: str(date.day), 2: f"{date.day:02}", 3: date.strftime("%a")}.get(len(q), date.strftime("%A")))
        elif q[0] == "h":
            hour = (h % 12 or 12) if half else h
            out.append(f"{hour:0{min(len(q), 2)}}")
            after_hour = True
        elif q[0] == "s":
            width = min(len(q.split(".")[0]), 2)
            frac = (seconds - int(seconds)).quantize(Decimal(10) ** -(len(q) - q.index(".") - 1), ROUND_HALF_UP) if "." in q else None
            out.append(f"{s:0{width}}" + (str(frac)[1:] if frac is not None else ""))
        elif p in ("AM/PM", "A/P"):
            out.append((p.split("/")[h >= 12]))
        else:
            out.append(_literal(p))
    return "".join(out)


def _literal(p: str) -> str:
    if p[0] == '"':
        return p[1:-1]
    if p[0] in "\\":
        return p[1:]
    if p[0] == "_":
        return " "
    if p[0] in "*":
        return ""
    if p[0] == "[":
        return m[1] if (m := re.match(r"\[\$([^-\]]*)", p)) else ""
    return p


def _number(value: float, parts: list[str], negative: bool) -> str:
    code = "".join(p for p in parts if len(p) == 1 and p in "0#?.,%/E+-" or p in "Ee")
    pre, post, seen = [], [], False
    for p in parts:
        if len(p) == 1 and p in "0#?.,/":
            seen = True
        elif p == "%" or (seen and p in ("E", "e", "+", "-") and "E" in code.upper()):
            (post if seen else pre).append("%" if p == "%" else "")
        elif p.isdigit() and seen and "/" in code:
            code += p
        else:
            (post if seen else pre).append(_literal(p))
    d = Decimal(repr(value)) * Decimal(100) ** code.count("%")
    sign = "-" if negative else ""
    if "/" in code:
        top = re.search(r"/([0#?]+|\d+)", code)
        most = int(top[1]) if top and top[1].isdigit() and top[1].strip("0") else 10 ** len(top[1]) - 1 if top else 9
        f = Fraction(d).limit_denominator(most) if not (top and top[1].isdigit() and top[1].strip("0")) else Fraction(round(d * most), most)
        whole, rest = divmod(f.numerator, f.denominator) if re.search(r"[0#?]\s*[0#?]+/", code) or "# " in "".join(parts) else (0, f.numerator)
        body = f"{whole} {rest}/{f.denominator}" if whole and rest else f"{rest}/{f.denominator}" if rest or not whole else str(whole)
        return sign + "".join(pre).strip() + body.strip() + "".join(post).strip()
    if m := re.search(r"E([+-])", code, re.I):
        mantissa = code[: m.start()]
        places = len(mantissa.split(".")[1]) if "." in mantissa else 0
        exp = len(code[m.end() :])
        step = max(1, len(re.sub(r"[^0#?]", "", mantissa.split(".")[0])))
        power = d.adjusted() if d else 0
        power -= power % step
        scaled = (d / Decimal(10) ** power).quantize(Decimal(10) ** -places, ROUND_HALF_UP)
        lead = "-" if power < 0 else "+" if m[1] == "+" else ""
        return f"{sign}{''.join(pre)}{scaled}E{lead}{abs(power):0{exp}}{''.join(post)}"
    body = code.replace("%", "")
    scale = len(body) - len(body.rstrip(","))
    d /= Decimal(1000) ** scale
    body = body.rstrip(",")
    left, _, right = body.partition(".")
    d = d.quantize(Decimal(10) ** -len(right), ROUND_HALF_UP)
    whole, _, frac = f"{d:f}".partition(".")
    keep = len(right) - len(right) if not right else max(i + 1 if c != "#" else 0 for i, c in enumerate(right))
    while len(frac) > keep and frac.endswith("0"):
        frac = frac[:-1]
    whole = whole.lstrip("0").zfill(left.replace(",", "").count("0"))
    if "," in left:
        whole = f"{int(whole or 0):,}" if len(whole) > 3 else whole
    return sign + "".join(pre) + whole + ("." + frac if frac or (right and keep) else "") + "".join(post)


def format_value(value: float, code: str | None, date1904: bool = False) -> str:
    """A number as a format code shows it."""
    if code is None or code == "@" or code.lower() == "general" or not math.isfinite(value):
        return general(value)
    section, v = _choose(value, _sections(code))
    if section.lower() == "general":
        return general(v)
    parts = _PART.findall(section)
    plain = [p for p in parts if p[0] not in '"\\_*' and not (p[0] == "[" and p.strip("[]").lower() not in ("h", "hh", "m", "mm", "s", "ss"))]
    if any(re.fullmatch(r"(?i)y+|m+|d+|h+|s+(\.0+)?|\[[hms]+\]", p) for p in plain) and not any(p in "0#?" for p in plain):
        if not date1904 and int(v) == 60:
            return general(v)
        return _date(v, [p for p in parts if not (p[0] == "[" and p not in plain)], date1904)
    if any(p == "General" for p in plain):
        return "".join(general(v) if p == "General" else _literal(p) for p in parts)
    shown = [p for p in parts if not re.fullmatch(r"\[(?:[A-Za-z]+\d*|[<>=].*)\]", p)]
    if not any(p in "0#?" for p in plain):
        return "".join(_literal(p) for p in shown)
    return _number(abs(v), shown, v < 0)


def _format(value: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else format_value(float(v), c) for v, c in zip(value, code)])


def formatted(value: Column, code: Column) -> Column:
    """Numbers by their format codes, in Arrow batches."""
    return F.pandas_udf(_format, "string")(value.cast("double"), code)
