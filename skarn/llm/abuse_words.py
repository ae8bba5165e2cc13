"""Word classes and example sentences the abuse model starts from; both are parameters of the operator.

A class names what a word can do in a sentence; no word decides alone. Words are listed in plain spelling (lower case,
no accents), in English, German, Spanish and French. The examples are general ones: none shares a run of four words with
a document of the test tables (tests/llm/test_abuse.py looks).
"""

CLASSES = {
    # names people are called
    "insult": """idiot moron imbecile cretin dumbass asshole arsehole dickhead shithead fuckhead wanker tosser prick twat cunt bitch bastard
        scumbag scum parasite troglodyte loser pig swine halfwit dimwit nitwit fool clown jackass jerk weasel maggot leech
        lowlife douchebag douche motherfucker fucker retard weirdo freak psycho coward crook liar donkey worm rat snake
        vollidiot arschloch hurensohn wichser mistkerl drecksau schwein sau depp trottel schwachkopf missgeburt penner spast spasti
        versager dummkopf bastarde nutte hure schlampe fotze drecksack arsch
        imbecil idiota estupido cretino gilipollas cabron payaso inutil maldito pendejo maricon puta zorra perra guarra asqueroso
        connard connasse salaud salope encule abruti batard ordure pourriture""",
    # scorn that goes with such a name, or with 'you'
    "scorn": """stupid dumb braindead brainless worthless pathetic spineless useless miserable lying ugly filthy disgusting shitty
        fucking goddamn ignorant incompetent gutless mindless retarded vile rotten smelly
        dumm dummes dummer dumme blod blodes bloder blode wertlos wertloses wertloser mieses mieser verlogen verlogenes verlogener
        dreckig dreckiges widerlich ekelhaft hasslich hirnlos hirnloses erbarmlich
        estupida sucio asquerosa mentiroso stupide debile minable pathetique""",
    "swear": "shit fuck fucked damn hell crap ass piss bullshit scheisse scheiss kacke mierda joder cono carajo merde putain bordel",
    # what is done to people in a threat
    "violence": """kill smash burn beat hang shoot stab bleed murder slit strangle choke drown rape gut hurt punch bury slap whip lynch torch behead
        umbringen toten schlagen stechen erschiessen aufschlitzen verprugeln matar romper quemar disparar apunalar degollar tuer casser egorger frapper bruler""",
    "death": "die dead suicide verrecke verreck krepier stirb sterben muerete mueras morir creve mourir",
    # groups of people
    "group": """immigrant immigrants migrants refugee refugees foreigner foreigners gay gays lesbian lesbians homosexuals women females muslim muslims jew jews
        jewish christians hindus blacks whites asians arabs africans mexicans gypsies roma disabled auslander frauen weiber fluchtlinge migranten schwule
        schwulen lesben juden muslime turken zigeuner behinderte extranjeros inmigrantes mujeres maricones negros judios musulmanes moros gitanos
        discapacitados refugiados etrangers immigres femmes juifs musulmans arabes noirs""",
    # what groups are called or wished
    "dehumanise": """vermin savage savages animals rats cockroach cockroaches parasites subhuman subhumans trash filth pests lice plague exterminated deported
        eradicated gassed infest inferior ungeziefer pack gesindel abschaum ausgerottet vergast parasiten untermenschen basura escoria plaga vermine racaille""",
    "sex": """horny nudes nude naked tits boobs pussy cock dick cum porn xxx slut whore blowjob handjob orgasm boner wank masturbate hardcore lick suck
        undress panties anal nipples penis vagina erection threesome milf schwanz nacktbilder titten ficken muschi geil nackt blasen bumsen
        polla desnuda desnudo tetas follar porno culo chupar nue nichons baiser seins""",
    "you": "you your youre yours u ur yourself du dich dir dein deine deinen deiner deinem ihr euch eurer tu tus te ti eres usted vos ton ta tes toi vous votre",
    "third": "him her them she he they his their those these ihm ihn ihnen sie er esa ese esos los las elle ils",
    "self": "i me my myself mine im ive ich mich mir mein meine yo mi mis je mon ma",
    "will": "will gonna going ill well werde werden voy vamos vais",
}

#: grade | sentence. 0 none, 1 insult, 2 degrading or sexually explicit, 3 threat or hatred.
EXAMPLES = """
1|fuck off, asshole
1|you dumb motherfucker
1|you spineless worm, you absolute waste of space
1|what a goddamn piece of trash you are
1|this minister is a fucking clown and a crook
1|that referee is a lying bastard
1|my landlord is a worthless pig and a liar
1|get out of here, you pathetic loser
1|no one likes you, scumbag
1|are you really this dumb, moron
1|go and rot, you disgusting rat
1|ignore this retard, he is a brainless cretin
1|du vollidiot, hau ab
1|dieser minister ist ein verlogener hurensohn
1|halt den mund, du dumme sau
1|was bist du fur ein erbarmlicher wichser
1|eres un estupido cabron y un inutil
1|vete al infierno, hijo de puta
1|cierra la boca, perra
1|que imbecil eres, das asco
1|ferme ta gueule, espece de connard
1|va te faire foutre, sale con
2|nice ass, bend over and show me
2|come sit on my face and ride my cock
2|i want you naked in my bed tonight
2|send me your nudes, baby, i feel horny
2|watch hot girls suck cock for free, hardcore porn
2|she sucked his cock to get the part, what a whore
2|that slut will fuck anyone for money
2|she slept with the director to get the role
2|i would bang her until she screams
2|ich will deine titten sehen
2|ich will dich ficken bis du schreist
2|fick dich, du missgeburt
2|quiero follarte y chupar tus tetas
2|chupame la polla
2|envoie moi des photos nue, salope
3|i will kill you and everyone you love
3|i have a gun and i know your address
3|we will come to your house and burn it down
3|somebody ought to shoot that mayor
3|next time we meet i break your neck
3|go and kill yourself
3|he should be shot, and his family too
3|immigrants are vermin
3|muslims are animals and must be deported
3|gays are a disease, get rid of all of them
3|women are inferior and too stupid to vote
3|jews are parasites
3|all refugees are filthy rats
3|ich bring dich um
3|ich weiss wo du wohnst, du bist tot
3|stirb endlich, du dreckiges stuck
3|alle auslander raus, das gesindel gehort vergast
3|juden sind parasiten
3|te mato, hijo de puta
3|vamos a encontrarte y quemar tu casa
3|malditos moros, fuera de aqui, son una plaga
3|ojala te mueras, asqueroso
3|je vais te tuer, je sais ou tu habites
3|les etrangers sont des parasites, dehors
0|fuck, i missed the train again
0|i am such an idiot, i left the keys inside
0|bloody hell, it is cold today
0|damn, that was a good goal
0|ich habe den zug verpasst, so ein mist
0|merde, j'ai oublie mes cles
0|mierda, perdi el autobus
0|the drug kills cancer cells
0|police said the man threatened to kill the mayor
0|the court heard that he had called her an idiot
0|the report counts insults such as moron and idiot in class
0|refugees found work in the town, the council said
0|local villagers protested against the mine
0|the council has two women and a foreigner
0|more women and disabled people were hired last year
0|she leads the office and reports to the minister
0|he wants him to sign the paper
0|you should read the book again, the end is fine
0|your bank shows an old balance
0|short sellers get burned when prices jump
0|they bit the bullet and cut the staff
0|bears got killed and bulls made a killing
0|the pilot of the nude beach project was stopped
0|animals and pests were kept out of the barn
0|thank you for your question
"""
