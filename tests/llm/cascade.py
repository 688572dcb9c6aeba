"""A plain rule cascade over the classes of a place, against which the model is measured."""


def rule(q) -> bool:
    """Whether a place ends a unit, decided from its features alone."""
    if q.after == "end":
        return True
    if q.quote == "inside" or q.after == "punct":
        return False
    if q.kind == "blank":
        return q.before == "thai" and q.after == "thai"
    begins = q.after in ("starter", "upper", "single", "caps")
    if q.quote != "none":
        if q.after == "lower":
            return False
        if q.quote.startswith("bracket"):
            return q.quote == "bracket at start"
        if q.quote == "quote led":
            return True
        return q.after == "starter"
    if q.kind in ("cjk", "danda"):
        return True
    if q.kind == "cjk dots":
        return False
    if q.kind == "dots":
        return begins
    if q.kind == "ask":
        return q.after in ("starter", "upper", "nocase", "cjk") if q.gap == "none" else q.after != "lower"
    if q.gap == "none":
        glued = q.after in ("starter", "upper") or q.after in ("cjk", "nocase")
        return glued and (q.before in ("word", "number", "digits", "ident") or (q.after == "starter" and q.before.startswith(("open", "letter"))))
    if q.before == "title":
        return False
    if q.before in ("letter", "initial", "rank"):
        return q.after == "starter" or (q.before == "letter" and q.after in ("ident", "low starter"))
    if q.before.startswith("open"):
        return q.after == "starter" or (q.before == "open:number" and q.after in ("digit", "ident", "low starter"))
    if q.before == "none":
        return begins
    return q.after != "lower"
