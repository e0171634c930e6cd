"""Short texts of each kind: profiles that stand beside those fitted on labels, for kinds and languages with few of them."""

from __future__ import annotations

# Texts by kind, prose in many languages and scripts among them.
SEEDS: dict[str, list[str]] = {
    "prose": [
        "The river had risen during the night, and by the time we came down to the bridge there was no way across. Nobody seemed to mind. They sat on the wall and talked about the harvest.",
        "I asked her why she had left so early. She said that the music was too loud, which was true, and that she had work to do in the morning.\n\nWe did not speak of it again.",
        "user: hey, can you tell me why the build is so slow today?\nassistant: It seems that the cache was emptied last night, so everything has to be compiled again.\nuser: ok thanks, I will wait then",
        "Als wir am Abend nach Hause kamen, war es schon dunkel. Niemand hatte das Licht angelassen, und so suchten wir eine Weile nach dem Schlüssel, der wie immer unter der Matte lag.",
        "Quand nous sommes arrivés au village, il faisait déjà nuit. La boulangerie était fermée et il n'y avait plus personne dans les rues, sauf un chien qui dormait devant l'église.",
        "Cuando llegamos al pueblo ya era de noche. No había nadie en la plaza y las tiendas estaban cerradas, pero una mujer nos abrió la puerta y nos dio algo de cenar.",
        "Quando siamo arrivati in paese era già notte. Non c'era nessuno nella piazza e i negozi erano chiusi, ma una donna ci ha aperto la porta e ci ha dato da mangiare.",
        "Il treno è partito in ritardo perché pioveva molto, e nessuno sapeva quando sarebbe arrivato.",
        "Quando chegámos à aldeia já era noite. Não havia ninguém na praça e as lojas estavam fechadas, mas uma mulher abriu-nos a porta e deu-nos de jantar.",
        "Toen we in het dorp aankwamen was het al donker. Er was niemand op het plein en de winkels waren gesloten, maar een vrouw deed de deur open en gaf ons te eten.",
        "När vi kom fram till byn var det redan mörkt. Det fanns ingen på torget och butikerna var stängda, men en kvinna öppnade dörren och gav oss något att äta.",
        "Kiedy dotarliśmy do wsi, było już ciemno. Na rynku nie było nikogo, a sklepy były zamknięte, ale pewna kobieta otworzyła nam drzwi i dała nam kolację.",
        "Když jsme přišli do vesnice, byla už tma. Na náměstí nikdo nebyl a obchody byly zavřené, ale jedna žena nám otevřela dveře a dala nám večeři.",
        "Kun saavuimme kylään, oli jo pimeää. Torilla ei ollut ketään ja kaupat olivat kiinni, mutta eräs nainen avasi oven ja antoi meille ruokaa.",
        "Köye vardığımızda hava çoktan kararmıştı. Meydanda kimse yoktu ve dükkânlar kapalıydı, ama bir kadın bize kapıyı açtı ve yemek verdi.",
        "Khi chúng tôi đến làng thì trời đã tối. Không có ai ở quảng trường và các cửa hàng đều đóng cửa, nhưng một người phụ nữ đã mở cửa và cho chúng tôi ăn tối.",
        "Ketika kami tiba di desa, hari sudah gelap. Tidak ada orang di alun-alun dan toko-toko sudah tutup, tetapi seorang perempuan membukakan pintu dan memberi kami makan malam.",
        "Когда мы пришли в деревню, было уже темно. На площади никого не было, магазины были закрыты, но одна женщина открыла нам дверь и накормила нас ужином.",
        "Вчера вечером шёл дождь, и мы остались дома.",
        "Όταν φτάσαμε στο χωριό ήταν ήδη νύχτα. Δεν υπήρχε κανείς στην πλατεία και τα μαγαζιά ήταν κλειστά, αλλά μια γυναίκα μας άνοιξε την πόρτα.",
        "عندما وصلنا إلى القرية كان الليل قد حل. لم يكن هناك أحد في الساحة وكانت المتاجر مغلقة، لكن امرأة فتحت لنا الباب وقدمت لنا العشاء.",
        "כאשר הגענו לכפר כבר היה חשוך. לא היה איש בכיכר והחנויות היו סגורות, אבל אישה אחת פתחה לנו את הדלת ונתנה לנו לאכול.",
        "जब हम गाँव पहुँचे तो अँधेरा हो चुका था। चौक में कोई नहीं था और दुकानें बंद थीं, लेकिन एक औरत ने दरवाज़ा खोला और हमें खाना दिया।",
        "我们到村子的时候天已经黑了。广场上一个人也没有，商店都关着门，但是有一位妇女给我们开了门，还请我们吃了晚饭。",
        "昨天下了很大的雨，所以我们没有出门。",
        "村に着いたときはもう暗くなっていた。広場には誰もおらず、店も閉まっていたが、一人の女性が戸を開けて夕食を出してくれた。",
        "우리가 마을에 도착했을 때는 이미 어두웠다. 광장에는 아무도 없었고 가게들은 문을 닫았지만, 한 여자가 문을 열고 저녁을 주었다.",
    ],
    "list": [
        "- apples\n- green pears\n- two lemons\n- bread\n- salt\n- soap",
        "1. Open account\n2. Reset router\n3. Blue folder\n4. docs/readme.md\n5. Old invoices\n6. Shared calendar",
        "src/main.py\nsrc/util.py\ndocs/index.md\ntests/data.csv\nsetup.cfg\nassets/logo.png",
        "Berlin\nMadrid\nNew York\nOslo\nSan Marino\nTunis\nVienna",
        "[ ] wash car\n[x] buy stamps\n[ ] call plumber\n[ ] fix lamp\n[x] pay rent",
    ],
    "table": [
        "name,age,city\nAnna,31,Oslo\nBen,27,Rome\nCem,45,Bonn\nDora,38,Lyon",
        "| id | state | count |\n|----|-------|-------|\n| 1 | open | 20 |\n| 2 | closed | 14 |\n| 3 | open | 7 |",
        "day\thigh\tlow\nMon\t21\t12\nTue\t19\t11\nWed\t23\t14\nThu\t20\t10",
        "NAME        SIZE    OWNER\nalpha       12      root\nbeta        4       root\ngamma       130     guest\ndelta       8       guest",
        "<table><tr><th>a</th><th>b</th></tr>\n<tr><td>1</td><td>2</td></tr>\n<tr><td>3</td><td>4</td></tr></table>",
    ],
    "code": [
        "import os\n\ndef total(rows):\n    out = 0\n    for row in rows:\n        out += row.size\n    return out\n\nprint(total(load()))",
        "const load = async (id) => {\n  const res = await fetch(`/api/${id}`);\n  if (!res.ok) {\n    throw new Error(res.status);\n  }\n  return res.json();\n};",
        "SELECT o.id, SUM(l.price) AS total\nFROM orders o\nJOIN lines l ON l.order_id = o.id\nWHERE o.state = 'open'\nGROUP BY o.id\nORDER BY total DESC;",
        "server:\n  port: 8080\n  hosts:\n    - alpha\n    - beta\nlogging:\n  level: info\n  path: /var/log/app",
        "$ cd /srv/app\n$ git pull --rebase\n$ docker compose up -d\n$ tail -n 50 logs/app.log | grep ERROR",
        "{\n  \"name\": \"demo\",\n  \"items\": [1, 2, 3],\n  \"nested\": {\"on\": true, \"size\": 4}\n}",
    ],
    "junk": [
        "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSBzZWNyZXQgYXQgYWxsIGJ1dCBqdXN0IHRleHQ0\nbW9yZSBvZiB0aGUgc2FtZSBraW5kIG9mIGxpbmUgdGhhdCBnb2VzIG9uIGFuZCBvbiBhbmQ5\nbGFzdCBsaW5lIG9mIGl0IGFsbCBlbmRzIGhlcmUgb3Igc29tZXdoZXJlIGVsc2UgZW50aXJl",
        "Skip to content » Home » Sign in » Pricing » Accept all cookies » Follow us » Back to top » © 2025",
        "loading...\n" * 30,
        "again and again and again and again and " * 12,
        "qz#k fj%w ;;x 8v!r pp^ k2k @@ zzv ]q[ w9~ xk| 7&d jj? vv% qq* 3z! mx$ ]]r kq+ zz- fq= x0_ vb\\ lp/",
        "ThÃ© rÃ©pÃ³rt wÃ¡s brÃ¶kÃ©n�� bÃ½ thÃ© sÃ©rvÃ©r� Ã¡nd nÃ³bÃ³dy� cÃ³uld rÃ©Ã¡d it",
        "00000000: 7f45 4c46 0201 0100 0000 0000 0000 0000\n00000010: 0300 3e00 0100 0000 a010 0000 0000 0000\n00000020: 4000 0000 0000 0000 7839 0000 0000 0000",
    ],
}
