"""Presentation MathML as LaTeX."""

from __future__ import annotations

from xml.etree import ElementTree as ET

# Characters that LaTeX writes as commands, and accents.
SYMBOLS = {"α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "φ": r"\phi", "ω": r"\omega", "Δ": r"\Delta", "Σ": r"\Sigma", "Ω": r"\Omega", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∞": r"\infty", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "±": r"\pm", "×": r"\times", "⋅": r"\cdot", "→": r"\to", "∈": r"\in", "∂": r"\partial", "∇": r"\nabla", "−": "-", "…": r"\ldots"}
ACCENTS = {"^": r"\hat", "¯": r"\overline", "→": r"\vec", "˙": r"\dot", "~": r"\tilde", "⃗": r"\vec"}
FUNCTIONS = frozenset("sin cos tan log ln exp lim max min det".split())


def to_latex(e: ET.Element) -> str:
    """The LaTeX of an element and what is in it; elements without a rule give their children."""
    tag, kids = e.tag.rsplit("}", 1)[-1], list(e)
    group = lambda k: "{" + to_latex(kids[k]) + "}" if k < len(kids) else "{}"
    if tag in ("mi", "mo", "mn", "mtext", "ms"):
        text = "".join(e.itertext()).strip()
        if tag == "mtext":
            return rf"\text{{{text}}}" if text else ""
        if tag == "mi" and text in FUNCTIONS:
            return "\\" + text + " "
        return "".join(SYMBOLS[c] + " " if SYMBOLS.get(c, "-")[0] == "\\" else SYMBOLS.get(c, c) for c in text)
    if tag == "mfrac":
        return r"\frac" + group(0) + group(1)
    if tag == "msqrt":
        return r"\sqrt{" + "".join(map(to_latex, kids)) + "}"
    if tag == "mroot":
        return r"\sqrt[" + (to_latex(kids[1]) if len(kids) > 1 else "") + "]" + group(0)
    if tag in ("msup", "msub", "msubsup", "munder", "mover", "munderover"):
        base = to_latex(kids[0]) if kids else ""
        if tag == "mover" and len(kids) == 2 and "".join(kids[1].itertext()).strip() in ACCENTS:
            return ACCENTS["".join(kids[1].itertext()).strip()] + "{" + base + "}"
        base = base if len(base.strip()) < 2 or base.startswith("\\") and base.strip()[1:].isalpha() else "{" + base + "}"
        marks = {"msup": "^", "mover": "^", "msub": "_", "munder": "_", "msubsup": "_^", "munderover": "_^"}[tag]
        return base.strip() + "".join(m + group(k + 1) for k, m in enumerate(marks))
    if tag == "mfenced":
        return r"\left" + e.get("open", "(") + (e.get("separators", ",")[:1] or "").join(map(to_latex, kids)) + r"\right" + e.get("close", ")")
    if tag == "mtable":
        rows = [" & ".join(to_latex(c) for c in r) for r in kids]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"
    if tag == "semantics":
        note = next((k.text for k in kids if k.tag.endswith("annotation") and "tex" in (k.get("encoding") or "").lower() and k.text), None)
        return note.strip() if note else to_latex(kids[0]) if kids else ""
    if tag == "mspace":
        return " "
    return "".join(map(to_latex, kids))


def mathml_to_latex(markup: str) -> str | None:
    """LaTeX of a math element's markup; null if it isn't well formed."""
    try:
        return " ".join(to_latex(ET.fromstring(markup)).split())
    except ET.ParseError:
        return None


def omml_to_latex(e: ET.Element) -> str:
    """The LaTeX of an Office formula's element; elements without a rule give what is in them."""
    tag = e.tag.rsplit("}", 1)[-1]
    kids = {k.tag.rsplit("}", 1)[-1]: k for k in e}
    of = lambda name: "{" + (omml_to_latex(kids[name]).strip() if name in kids else "") + "}"
    value = lambda part, name, default: next((next(iter(x.attrib.values()), "") for x in kids.get(part, ()) if x.tag.endswith("}" + name)), default)
    if tag == "t":
        return "".join(SYMBOLS.get(c, c) + (" " if SYMBOLS.get(c, "-")[0] == "\\" else "") for c in e.text or "")
    if tag == "f":
        return r"\frac" + of("num") + of("den")
    if tag in ("sSup", "sSub", "sSubSup"):
        return of("e") + ("_" + of("sub") if "sub" in kids else "") + ("^" + of("sup") if "sup" in kids else "")
    if tag == "rad":
        deg = of("deg")[1:-1]
        return r"\sqrt" + (f"[{deg}]" if deg else "") + of("e")
    if tag == "nary":
        sign = value("naryPr", "chr", "∫")
        return SYMBOLS.get(sign, sign) + ("_" + of("sub") if of("sub") != "{}" else "") + ("^" + of("sup") if of("sup") != "{}" else "") + of("e")
    if tag == "d":
        inner = ",".join(omml_to_latex(k).strip() for k in e if k.tag.endswith("}e"))
        return r"\left" + value("dPr", "begChr", "(") + inner + r"\right" + value("dPr", "endChr", ")")
    if tag == "acc":
        mark = {"̂": r"\hat", "̅": r"\overline", "⃗": r"\vec", "̇": r"\dot", "̃": r"\tilde"}.get(value("accPr", "chr", "̂"), r"\hat")
        return mark + of("e")
    if tag == "m":
        rows = [" & ".join(omml_to_latex(c).strip() for c in r if c.tag.endswith("}e")) for r in e if r.tag.endswith("}mr")]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"
    if tag == "func":
        name = of("fName")[1:-1].strip()
        return ("\\" + name if name in FUNCTIONS else name) + of("e")
    return "".join(omml_to_latex(k) for k in e if not k.tag.endswith("Pr"))
