"""Word lists of our own choice: short ones, for the build sides of membership tests. Give longer ones through the configuration."""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


#: Organisations that are found by name, in any case.
ORGS = (
    "Goldman Sachs", "Standard Bank", "Deutsche Bank", "McKinsey", "Deloitte", "KPMG", "Bain", "Accenture", "Capgemini", "Rothschild", "Lazard", "Blackstone",
    "Allianz", "Zurich Insurance", "Swiss Re", "Munich Re", "Maersk", "Heineken", "Carlsberg", "Ikea", "Lufthansa", "Red Cross", "World Bank", "EY",
)
#: Banks and insurers, in lower case.
INSTITUTIONS = (
    "standard bank", "goldman sachs", "deutsche bank", "absa", "barclays", "hsbc", "natwest", "lloyds bank", "santander", "rabobank", "commerzbank", "bnp paribas",
    "credit agricole", "unicredit", "nordea", "danske bank", "wells fargo", "citibank", "royal bank of canada", "westpac",
)
#: Companies whose executives are public: a role before one of them isn't redacted.
PUBLIC_COMPANIES = _words("Siemens Nestle Unilever Philips Nokia Ericsson Airbus Boeing Renault Honda Toyota Nissan Bosch Microsoft Apple Google Amazon")
#: Hosts that identify nobody.
SAFE_DOMAINS = _words(
    "apache.org archive.org arxiv.org debian.org doi.org github.com gnu.org google.com ietf.org iso.org kernel.org mozilla.org openstreetmap.org python.org unicode.org w3.org "
    "who.int wikimedia.org wikipedia.org youtube.com"
)
#: Words that make a capitalised word near them a company, in lower case.
ORG_CONTEXT = _words("company firm corporation startup subsidiary client supplier vendor retailer manufacturer insurer employer contractor acquired merged founded shareholders investors plc gmbh inc ltd")
#: Words that make a run of capitalised words an organisation; endings that make a person's name one, in lower case.
ORG_WORDS = _words("Inc Ltd LLC PLC GmbH Group Holdings Partners Capital Bank Insurance Association Institute University Foundation Consulting Industries Logistics Systems")
ORG_SUFFIXES = _words("inc ltd llc plc gmbh group holdings partners capital insurance")
#: Whole phrases that look like organisations, and words that are none, in lower case.
GENERIC_ORGS = ("parent company", "holding company", "central bank", "investment bank", "local university", "working group", "steering group", "target group")
NOT_ORGS = _words("monday tuesday wednesday thursday friday saturday sunday introduction conclusion chapter section figure appendix internet website question answer customer")
#: Capitalised words that are nobody's name, in lower case.
NOT_NAMES = _words("dear regards sincerely hi hey okay sorry madam sir mister professor doctor christmas easter english mathematics physics history period power")
DETERMINERS = _words("a an the this that these those my your our their every each no")
#: Nationalities in lower case: single ones are no names.
NATIONALITIES = _words("german french italian spanish portuguese dutch belgian polish czech greek turkish kenyan nigerian egyptian chinese japanese indian brazilian american british")
#: Words that start no person's name and are none, in lower case.
COMMON_WORDS = _words(
    "after again also although always and another are because been before being between both but can could did does during each even every few first for from had has have "
    "hello here how however into just last later let like many may maybe more most much must never new next not note now often once only other over please quite "
    "really same say see she should since some still such sure than thank thanks that the their them then there these they this those though through today tomorrow "
    "under until very was well were what when where which while who will with would yes yesterday you your review report meeting board team project quarterly series"
)
FIRST_NAMES = _words(
    "Aisha Alex Amy Andrew Anna Anthony Ben Carlos Carol Charles Chris Daniel David Diana Elena Emily Emma Eric Fatima George Grace Hannah Helen Henry Isabel Jack Jacob "
    "James Jane Jason Jean Jessica John Joseph Julia Karen Kevin Kim Laura Linda Lisa Lucas Maria Mark Mary Matthew Michael Mike Mohammed Nancy Nina Olivia Patricia "
    "Paul Peter Priya Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Sipho Sofia Steven Susan Thabo Thomas Tim Victor Walter William Yusuf Zanele Zoe"
)
WHITELIST = _words("SLACK ZOOM AWS GITHUB GOOGLE JIRA EXCEL PYTHON DOCKER LINUX AZURE OUTLOOK TEAMS NOTION API SQL CRM SAAS CEO CFO CTO")
#: Made-up values by type.
PHANTOMS = {
    "PERSON": _words("Robin Kai Noa Sage Rowan Ellis Marlow Lennox Arden Remy Tatum Wren"),
    "ORG": ("Bluefinch Works", "Harbour & Pine", "Ostrava Mills", "Quillon Group", "Tern Logistics", "Larkfield"),
    "AMOUNT": ("$1,111", "$2,222", "$3,333", "$4,444", "$5,555"),
    "DATE": ("some day", "one spring", "a later day", "that autumn"),
    "PHONE": ("555-0131", "555-0142", "555-0153", "555-0164"),
    "EMAIL": ("someone@example.org", "office@example.org", "desk@example.org", "post@example.org", "mailbox@example.org"),
    "GOVID": ("ID 000 001", "ID 000 002", "ID 000 003"),
    "CARD": ("0000 0000 0000 0001", "0000 0000 0000 0002"),
    "BANKACCT": ("account A", "account B", "account C"),
    "IPADDR": ("192.0.2.1", "192.0.2.2", "198.51.100.1", "203.0.113.1"),
    "ADDRESS": ("1 Nowhere Lane", "2 Nowhere Lane", "3 Nowhere Lane"),
    "ROLE": ("an office holder", "a manager", "an adviser"),
    "SITUATION": ("a certain matter", "another matter", "a third matter"),
    "TEMPORAL": ("at some point", "in due course", "around then"),
}
