"""Word lists for names and addresses, each from the public list that its comment names."""

from __future__ import annotations


def _variants(text: str) -> dict[str, str]:
    """Variant -> standard form, from lines "standard: variants"."""
    lines = (line.split(":") for line in text.strip().splitlines())
    return {word: to.strip() for to, words in lines for word in words.split()}


#: Street suffixes, secondary units and directions by USPS Publication 28 (appendices B, C1 and C2), standard first;
#: French street types by the postal norm AFNOR XP Z10-011; Spanish, German and Indian ones as maps abbreviate them.
STREET_WORDS = _variants("""
aly: alley
anx: annex
apt: apartment
arc: arcade
ave: av avenue avenida
bch: beach
bldg: building batiment
blvd: bd boulevard boul
br: branch
brg: bridge
byp: bypass
cir: circle
cl: calle
col: colony
cor: corner
ct: court
ctr: center centre
cyn: canyon
dept: department
dr: drive
e: east
est: estate
expy: expressway
fbg: faubourg
fl: floor
ft: fort
gdn: garden
gdns: gardens
grn: green
hbr: harbor harbour
hts: heights
hwy: highway
imp: impasse
is: island
jct: junction
lk: lake
ln: lane
mkt: market
mt: mount
mtn: mountain
n: north
ne: northeast
ngr: nagar
no: number nos
nw: northwest
pkwy: parkway
pl: place
plz: plaza
qu: quai
rd: road
rm: room
rte: route
s: south
se: southeast
sec: sector
spg: spring
sq: square
st: street str saint strasse
sta: station
ste: suite
sw: southwest
ter: terrace
trl: trail
tpke: turnpike
vlg: village
vly: valley
w: west
che: chemin
res: residence
zi: zone
""")
#: Words of firms' names by the usual abbreviations of commercial registers, and plurals that come and go.
FIRM_WORDS = _variants("""
assn: association
assoc: associate associates
bros: brothers
co: company compagnie kompanie
corp: corporation
ent: enterprise enterprises
govt: government
hosp: hospital hospitals
hotel: hotels
inc: incorporated
ind: industry industries
inst: institute institution
intl: international
ltd: limited
mfg: manufacturing
mgmt: management
natl: national
prod: product products
pvt: private
rest: restaurant restaurants
sch: school schools
sol: solution solutions
store: stores
svc: service services
sys: system systems
tech: technology technologies
trader: traders
univ: university
food: foods
""")
#: Word -> canonical word.
CANON = STREET_WORDS | FIRM_WORDS
#: Words that carry nothing: articles, and prepositions and conjunctions between words of a name.
DROP = frozenset("a an and at das de del der des die du el en et for in la las le les los of the und y".split())
#: Abbreviations of legal forms by the ISO 20275 list of entity legal forms (India, United States, United Kingdom, France,
#: Germany, Spain, Italy, Netherlands, Australia), in canonical words; longest first.
LEGAL = sorted(
    (tuple(x.split(" ")) for x in "ag,bv,co,co ltd,corp,eurl,ev,gmbh,gmbh co kg,inc,kg,kgaa,l l c,l l p,llc,llp,lp,ltd,nv,ohg,pc,plc,pllc,pty ltd,pvt,pvt ltd,sa,sarl,sas,sasu,sca,sci,scs,se,sl,slu,snc,spa,srl,ug".split(",")),
    key=lambda t: (-len(t), t),
)
#: Legal forms and forms of address that may begin a name.
LEADING_LEGAL = tuple("eurl messrs ms sarl sas sci shree shri smt sri".split())
#: Cues of a second name: the phrases of trade name registers and their abbreviations.
DBA = r"\b(?:d/?b/?a|doing business as|trading as|t/a|operating as|o/a|a/?k/?a|also known as|formerly known as|formerly|f/k/a)\b"
#: Cues of a landmark in an address: English and French prepositions and adverbs of place, folded.
LANDMARK = (
    r"\b(?:above|across from|adjacent to|adj to|at the back of|behind|below|beside|besides|close to|facing|in front of|landmark|near|next to|nr|opp|opposite|"
    r"a cote de|au dessus de|derriere|devant|en face de|face a|pres de|proche de|vis a vis de)\b"
)
#: States by ISO 3166-2:US and ISO 3166-2:IN, with names and codes that the latter had before.
STATES = {
    name: code
    for pair in """
al alabama,ak alaska,az arizona,ar arkansas,ca california,co colorado,ct connecticut,de delaware,dc district of columbia,fl florida,ga georgia,hi hawaii,
id idaho,il illinois,in indiana,ia iowa,ks kansas,ky kentucky,la louisiana,me maine,md maryland,ma massachusetts,mi michigan,mn minnesota,ms mississippi,mo missouri,
mt montana,ne nebraska,nv nevada,nh new hampshire,nj new jersey,nm new mexico,ny new york,nc north carolina,nd north dakota,oh ohio,ok oklahoma,or oregon,
pa pennsylvania,ri rhode island,sc south carolina,sd south dakota,tn tennessee,tx texas,ut utah,vt vermont,va virginia,wa washington,wv west virginia,
wi wisconsin,wy wyoming,
ap andhra pradesh,arp arunachal pradesh,as assam,br bihar,cg chhattisgarh,cg chattisgarh,ch chandigarh,dl delhi,gj gujarat,goa goa,hp himachal pradesh,hr haryana,
jh jharkhand,jk jammu and kashmir,ka karnataka,kl kerala,mh maharashtra,ml meghalaya,mn manipur,mp madhya pradesh,mz mizoram,nl nagaland,od odisha,
od orissa,pb punjab,py puducherry,rj rajasthan,sk sikkim,tg telangana,tn tamil nadu,tr tripura,uk uttarakhand,uk uttaranchal,up uttar pradesh,wb west bengal
""".replace("\n", "").split(",")
    for code, name in [pair.split(" ", 1)]
}
#: What English abbreviations become when they are written in an Indic script and read back letter by letter.
SPELLED = {"pra": "pvt", "li": "ltd", "limitet": "ltd", "elelpi": "llp", "aiti": "it", "kampani": "co"}
#: Endings of web domains that mark a name as one.
TLDS = "biz com co de es fr in info io net org us".split()
#: Latin letters with a mark and what is left of each without it.
MARKED = "àáâãäåāçćčèéêëēęìíîïīñńòóôõöøōùúûüūýÿžźżšśł"
PLAIN = "aaaaaaaccceeeeeeiiiiinnooooooouuuuuyyzzzssl"
