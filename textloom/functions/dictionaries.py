"""Phrase dictionaries: a line for each entry, phrase and replacement apart by an equals sign."""

from __future__ import annotations


def _read(text: str) -> dict[str, str]:
    return dict(tuple(x.strip() for x in line.split("=", 1)) for line in text.strip().splitlines())


#: In the order in which they apply.
REDUNDANT = _read(
    """
    at the present time=now
    due to the fact that=because
    for the purpose of=for
    in the event that=if
    in order to=to
    a majority of=most
    a number of=many
    in spite of the fact that=although
    in the near future=soon
    it is clear that=
    it should be noted that=
    it is important to note that=
    it is worth noting that=
    needless to say=
    the fact that=that
    """
)

#: Alternatives by short form.
SIMPLER = {
    "e.g.": ["for instance", "for example"], "i.e.": ["in other words", "that is"], "etc.": ["etcetera", "and so forth", "and so on"],
    "re:": ["with respect to", "in relation to", "concerning", "regarding"], "vs.": ["as opposed to", "versus"], "et al.": ["et alii", "and others"],
    "AD": ["anno domini", "in the year"], "BCE": ["before christ", "before the common era"],
    "hr": ["hour", "hours"], "min": ["minute", "minutes"], "sec": ["second", "seconds"],
    "kg": ["kilogram", "kilograms"], "g": ["gram", "grams"], "mg": ["milligram", "milligrams"], "km": ["kilometer", "kilometers"], "m": ["meter", "meters"], "cm": ["centimeter", "centimeters"], "mm": ["millimeter", "millimeters"],
    "Prof.": ["professor"], "Dr.": ["doctorate", "doctor"], "Mr.": ["mister"], "Mrs.": ["missus"],
    "UN": ["united nations"], "USA": ["united states of america"], "UK": ["united kingdom"], "EU": ["european union"], "WHO": ["world health organization"],
}

_ACADEMIC = """
a growing body of literature=research
a large number of studies=many studies
a plethora of studies=many studies
conceptual framework=framework
empirical evidence suggests=evidence suggests
extant literature=existing research
in the literature=in research
it has been demonstrated that=
it is widely accepted that=
meta-analysis=review
methodological approach=method
previous studies have shown=research shows
the literature suggests=research suggests
theoretical underpinnings=theory
to the best of our knowledge=
"""
_BUSINESS = """
business-to-business=B2B
business-to-consumer=B2C
chief executive officer=CEO
chief financial officer=CFO
chief information officer=CIO
chief operating officer=COO
chief technology officer=CTO
customer relationship management=CRM
generally accepted accounting principles=GAAP
human resources=HR
initial public offering=IPO
key performance indicator=KPI
mergers and acquisitions=M&A
profit and loss=P&L
quarter over quarter=QoQ
research and development=R&D
return on investment=ROI
standard operating procedure=SOP
year over year=YoY
"""
_LEGAL = """
aforementioned=mentioned
bona fide=genuine
de facto=in fact
de jure=by law
for the avoidance of doubt=
force majeure=unforeseeable circumstances
hereinafter=later
in accordance with=per
including but not limited to=including
inter alia=among other things
mutatis mutandis=with necessary changes
notwithstanding=despite
per se=by itself
prima facie=on first view
pursuant to=per
status quo=current state
without prejudice to=without affecting
"""
_MEDICAL = """
activities of daily living=ADL
blood pressure=BP
body mass index=BMI
cardiovascular disease=CVD
chronic obstructive pulmonary disease=COPD
coronary artery disease=CAD
diabetes mellitus=DM
electronic health record=EHR
electronic medical record=EMR
emergency department=ED
four times a day=QID
intensive care unit=ICU
myocardial infarction=MI
over the counter=OTC
quality of life=QoL
randomized controlled trial=RCT
three times a day=TID
twice a day=BID
"""
_TECHNICAL = """
application programming interface=API
artificial intelligence=AI
cascading style sheets=CSS
command line interface=CLI
database management system=DBMS
extensible markup language=XML
graphical user interface=GUI
hypertext markup language=HTML
information technology=IT
integrated development environment=IDE
internet of things=IoT
JavaScript Object Notation=JSON
machine learning=ML
natural language processing=NLP
object-oriented programming=OOP
operating system=OS
random access memory=RAM
representational state transfer=REST
user experience=UX
user interface=UI
"""
DOMAINS = {"academic": _read(_ACADEMIC), "business": _read(_BUSINESS), "legal": _read(_LEGAL), "medical": _read(_MEDICAL), "technical": _read(_TECHNICAL)}
