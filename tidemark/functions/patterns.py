"""Patterns and phrases that must equal those of the texts' publishers and of the published scores."""

from __future__ import annotations

# Fixed value: a press release's place and date.
DATE_LINE = r"[A-Z][A-Z\s]+[,.]?\s+[A-Z][a-z]+\.?\s*(—|--|–)\s*[A-Z][a-z]+\s+\d{1,2}\s*,?\s*20\d{2}\s*"

# Boilerplate, removed in this order, letter case ignored, each match replaced by a blank.
BOILERPLATE = [
    r"image\s*source\s*:\s*the\s+motley\s+fool\s*\.\s*",
    r"image\s*source\s*:\s*getty\s+images\s*\.\s*",
    r"\(\s*[A-Z]{1,5}\s+[\d.]+%\s*\)",
    r"(Q[1-4]\s+\d{4}\s+)?Earnings\s+Call\s+[A-Z][a-z]{2}\s+\d{1,2}\s*,\s*\d{4}\s*,\s*\d{1,2}:\d{2}\s*(a\.?m\.?|p\.?m\.?)\s*(ET|PT|CT)",
    r"Contents\s*:\s*Prepared\s+Remarks\s+Questions\s+and\s+Answers\s+Call\s+Participants",
    r"Prepared\s+Remarks\s*:\s*",
    r"Questions\s+and\s+Answers\s*:\s*",
    r"Call\s+Participants\s*:\s*",
    r"Takeaways\s*",
    r"More\s+[A-Z]{1,5}\s+analysis\s+All\s+earnings\s+call\s+transcripts\s*",
    r"The\s+Motley\s+Fool\s+has\s+a\s+disclosure\s+policy\s*\.\s*",
    r"This\s+article\s+was\s+originally\s+published\s+on\s+The\s+Motley\s+Fool\s*\.\s*",
    r"Should\s+you\s+invest\s+\$[\d,]+\s+in\s+[A-Z][a-z]+\s+right\s+now\s*\?\s*",
    r"Before\s+you\s+buy\s+stock\s+in\s+[A-Z][a-z]+[,.]?\s+consider\s+this\s*:?\s*",
    r"The\s+Motley\s+Fool\s+Stock\s+Advisor\s+analyst\s+team\s+just\s+identified[^.?!]*[.?!]",
    r"See\s+the\s+10\s+stocks\s*\.\s*",
    r"When\s+our\s+analyst\s+team\s+has\s+a\s+stock\s+tip[^.?!]*[.?!]",
    r"©\s*20\d{2}\s*All\s+rights\s+reserved\s*\.\s*",
    r"Exhibit\s+99\.\d\s*",
    r"FOR\s+IMMEDIATE\s+RELEASE\s*",
    DATE_LINE,
    r"Item\s+\d+\.\d+\s+[A-Za-z\s]+(and\s+)?[A-Za-z\s]+",
    r"(This|The)\s+(press\s+release|communication|report|filing|document|call|presentation)\s+(contains|includes|may\s+contain)\s+(forward[\s-]*looking|\"forward-looking\")\s+statements.*?actual\s+results\s+(could|may|might|will|to)\s+(differ|vary|be)\s+[^.?!]*[.?!]",
    r"(This|The)\s+(call|conference|presentation)\s+(contains|includes|may\s+contain)\s+forward[\s-]*looking\s+statements[^.?!]*[.?!]",
    r"Safe\s+Harbor\s+(Statement|Provision)[^.]*\.",
    r"All\s+rights\s+reserved\s*\.\s*",
    r"©\s*20\d{2}\s*[A-Za-z\s,]+\s*",
    r"(Investor|Media|Press)\s+(Relations?|Contact)\s*:?\s*[A-Z][a-z]+\s+[A-Z][a-z]+[^.]*\.?",
    r"SOURCE\s+[A-Za-z\s]+\s*",
    r"For\s+(more|further)\s+information[,.]?\s*(contact\s*:?\s*)?[A-Z][a-z]+\s+[A-Z][a-z]+[^.]*\.?",
    r"(Operator|Coordinator|Conference\s+Operator)\s*:?\s*Good\s+(morning|afternoon|evening|day)[^.?!]*[.?!]",
    r"(Operator|Coordinator)\s+[A-Z][a-z]+\s+name\s+is[^.?!]*[.?!]",
    r"Good\s+(morning|afternoon|evening|day)[,.]?\s+(and\s+)?welcome\s+to[^.?!]*[.?!]",
    r"Today'?s\s+conference\s+(call\s+)?is\s+being\s+recorded\s*\.\s*",
    r"All\s+lines\s+have\s+been\s+placed\s+on\s+mute[^.?!]*[.?!]",
    r"I\s+would\s+(now\s+)?like\s+to\s+(turn|hand)\s+the\s+(conference|call)\s+over\s+to[^.?!]*[.?!]",
    r"At\s+this\s+time[,.]?\s+I\s+would\s+like\s+to\s+welcome\s+everyone[^.?!]*[.?!]",
    r"Please\s+go\s+ahead[,.]?\s*(sir|ma'am|Mr\.?|Ms\.?|Dr\.?)\s*\.?",
    r"Thank\s+you[,.!]?\s*(We\s+will\s+now\s+begin|I\s+will\s+now\s+turn)[^.?!]*[.?!]",
    r"(Your|Our|The|Next)\s+question\s+(comes\s+from|is\s+from)\s+[A-Z][a-z]+\s+[A-Z][a-z]+[^.?!]*[.?!]",
    r"(Our|The)\s+(next\s+)?question\s+(comes\s+from|is\s+from)\s+the\s+line\s+of[^.?!]*[.?!]",
    r"Operator\s*:?\s*[A-Z][a-z]+\s+(name\s+is|here|will|would|now|today|welcome|thank)[^.?!]*[.?!]\s*",
    r"I\s+(would|will|want|'d)\s+(now\s+)?like\s+to\s+(turn|hand)\s+(the\s+)?(call|conference)\s+over\s+to[^.?!]*[.?!]\s*",
    r"Question[\s-]*and[\s-]*Answer\s+Session\s*",
    r"&(amp|lt|gt|quot|apos|nbsp);",
]

# Phrases that mark a line as boilerplate.
BOILERPLATE_PHRASES = [
    "image source: getty images",
    "this article was originally published",
    "the motley fool has a disclosure policy",
    "should you invest",
    "where to invest",
    "before you buy stock in",
    "the motley fool stock advisor",
    "see the 10 stocks",
    "when our analyst team has",
    "©",
    "all rights reserved",
]

# Where questions begin in flat text, who moderates, where questions begin in turns, hedging phrases.
SECTION_MARK = r"\bQuestions\s*(?:and|&)\s*Answers\s*:|\bQuestion-and-Answer\s+Session"
MODERATOR = r"\boperator\b|\bcoordinator\b|\bmoderator\b"
QUESTIONS_BEGIN = r"question[-\s]*and[-\s]*answer|q\s*&\s*a\s+session|first\s+question|begin\s+the\s+question|open\s+the\s+(call|line|floor)s?\s+for\s+question|take\s+(our|your|the)\s+first\s+question|question[-\s]*answer\s+session"
HEDGES = r"\b(?:i\s+think|we\s+believe|sort\s+of|kind\s+of|it\s+depends|too\s+early\s+to|we'?ll\s+(?:have\s+to\s+)?see|hard\s+to\s+say|difficult\s+to\s+(?:say|predict|estimate)|not\s+going\s+to\s+(?:comment|guide|speculate)|can'?t\s+comment|won'?t\s+comment|we\s+don'?t\s+(?:guide|disclose|break\s+out)|as\s+i\s+(?:said|mentioned)|remains?\s+to\s+be\s+seen|wait\s+and\s+see)\b"

# Small lexicons of our own for the tables at hand; callers pass the published ones.
POSITIVE = ["gain", "gains", "improve", "improved", "improving", "strong", "stronger", "better", "boost", "grew", "growth", "helped", "lifted", "beat", "favorable", "efficient", "opportunity", "profitable", "strengthened", "accelerated"]
NEGATIVE = ["loss", "losses", "decline", "declined", "weak", "weaker", "slow", "slower", "slowed", "hurt", "fell", "slipped", "dropped", "delayed", "risk", "risks", "cut", "uncertainty", "uncertainties", "unavoidable"]
VALENCE = {"strong": 2.3, "better": 1.9, "helped": 1.7, "boost": 1.7, "thank": 1.5, "improved": 2.1, "good": 1.9, "fair": 1.3, "confident": 2.2, "favorable": 2.0, "hurt": -2.4, "weak": -1.9, "hard": -0.4, "lost": -1.3, "cut": -1.1, "risk": -1.1, "delayed": -0.9, "loss": -1.3, "unavoidable": -0.8, "tough": -0.5}
