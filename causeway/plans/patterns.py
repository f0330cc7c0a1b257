"""Patterns that tell causal titles and take their phrases out."""

# What marks a title as a causal claim, outright or in the language of reports, and what rules it out.
EXPLICIT = (
    r"\b(causes?|caused\s+by|leading\s+to|leads?\s+to|results?\s+in|results?\s+from|result(?:ing)?\s+from)\b",
    r"\b(triggers?|triggered\s+by|produces?|generated\s+by|induces?|induced\s+by)\b",
    r"\b(promotes?|prevents?|inhibits?|suppresses?|blocks?|drives?|driven\s+by)\b",
    r"\b(increases?|decreases?|reduces?|boosts?|lowers?|raises?|doubles?|triples?|halves?)\b",
    r"\b(improves?|worsens?|accelerates?|slows?|delays?|extends?|shortens?)\b",
    r"\b(risk\s+(?:of|factor\s+for)|increases?\s+risk|reduces?\s+risk|linked\s+to\s+(?:higher|lower))\b",
    r"\b(contributes?\s+to|responsible\s+for|accounts?\s+for|explains?)\b",
    r"\b(via|through|by\s+(?:increasing|decreasing|blocking|activating|inhibiting))\b",
    r"\b(?:does?\s+not|doesn'?t|cannot|can'?t|fail(?:s)?\s+to|never)\s+(?:cause|lead\s+to|result\s+in|trigger|increase|decrease|reduce|improve|prevent)\b",
    r"\bno\s+(?:significant\s+)?(?:evidence|link|association|connection|relationship|effect|impact)\b",
    r"\bnot\s+(?:linked\s+to|associated\s+with|correlated\s+with|causally\s+related)\b",
)
IMPLICIT = (
    r"\b(shows?\s+that|found?\s+that|suggests?\s+that|demonstrates?\s+that|reveals?\s+that|indicates?\s+that)\b",
    r"\b(finds?\s+that|reports?\s+that|confirms?\s+that|proves?\s+that)\b",
    r"\b(due\s+to|because\s+of|as\s+a\s+result\s+of|in\s+response\s+to|following)\b",
    r"\b(associated\s+with|correlated\s+with|connected\s+to|tied\s+to|linked\s+to)\b",
    r"\b(treatment\s+(?:with|of)|exposure\s+to|administration\s+of|use\s+of)\b.*\b(reduces?|prevents?|improves?|increases?)\b",
)
EXCLUDED = (
    r"^\s*(?:watch|video|image|gallery|photo|photos)\b",
    r"\b(?:ama|ask\s+me\s+anything|discussion)\b",
    r"^\s*\d+\s+(?:things|ways|reasons|facts)\b",
)

# Phrase patterns in the order they are tried, as (pattern, group of the cause, group of the effect). Negated claims come first.
NEGATED = (
    (r"^(.+?)\s+(?:does?\s+not|doesn'?t|cannot|can'?t|fail(?:s)?\s+to|never)\s+(?:lead\s+to|result\s+in|cause|trigger|produce|drive)\s+(.+)$", 1, 2),
    (r"^(.+?)\s+(?:does?\s+not|doesn'?t|cannot|can'?t|fail(?:s)?\s+to)\s+(?:increase|decrease|reduce|boost|lower|raise|improve|worsen|prevent|inhibit|promote)\s+(.+)$", 1, 2),
    (r"^(.+?)\s+(?:is|are)\s+not\s+(?:linked\s+to|associated\s+with|correlated\s+with|connected\s+to|tied\s+to)\s+(.+)$", 1, 2),
    (r"^(?:.{0,40}?\s+)?no\s+(?:significant\s+)?(?:evidence|link|association|connection|relationship)\s+(?:between\s+|that\s+|for\s+)?(.+?)\s+(?:and|to|with)\s+(.+)$", 1, 2),
    (r"^.{0,60}(?:finds?\s+no|shows?\s+no|found\s+no|reveals?\s+no)\s+(?:evidence|link|association)\s+(?:between\s+|that\s+)?(.+?)\s+(?:and|to|causes?|increases?|reduces?)\s+(.+)$", 1, 2),
)
AFFIRMED = (
    (r"^(.+?)\s+(?:leads?\s+to|results?\s+in|causes?|triggers?|produces?|drives?)\s+(.+)$", 1, 2),
    (r"^(.+?)\s+(?:is|are)\s+(?:caused|triggered|driven|induced)\s+by\s+(.+)$", 2, 1),
    (r"^(.+?)\s+(?:linked\s+to|associated\s+with|correlated\s+with|connected\s+to|tied\s+to)\s+(.+)$", 1, 2),
    (r"^(.+?)\s+(?:increases?|decreases?|reduces?|boosts?|lowers?|raises?|improves?|worsens?|doubles?|halves?|extends?|shortens?|accelerates?|delays?)\s+(.+)$", 1, 2),
    (r"^(.+?)\s+(?:prevents?|inhibits?|suppresses?|blocks?|promotes?)\s+(.+)$", 1, 2),
    (r"^.{0,60}(?:shows?\s+that|finds?\s+that|suggests?\s+that|reveals?\s+that|demonstrates?\s+that|reports?\s+that)\s+(.+?)\s+(?:increases?|decreases?|reduces?|causes?|leads?\s+to|prevents?|improves?|worsens?|triggers?|promotes?)\s+(.+)$", 1, 2),
    (r"^(.+?)\s+(?:due\s+to|because\s+of|as\s+a\s+result\s+of|in\s+response\s+to)\s+(.+)$", 2, 1),
)
#: Place of the report pattern among AFFIRMED; an earlier one always takes its titles unless it is moved to the front.
REPORT = 5
