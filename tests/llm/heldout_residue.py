"""Messages and look-alikes that take no part in making the rules: messages as public software prints them, and sentences of ordinary prose, manuals and news."""

RESIDUE = """
Not Found The requested URL was not found on this server.
Internal Server Error
The server encountered an internal error or misconfiguration and was unable to complete your request.
You are not authorized to view this page.
You don't have permission to access / on this server.
Hmmm… can't reach this page
This site can’t be reached
The connection was reset
Server Not Found
Unable to connect
This webpage is not available
Error establishing a database connection
Briefly unavailable for scheduled maintenance. Check back in a minute.
There has been a critical error on this website.
We're sorry, but something went wrong.
The change you wanted was rejected.
Sorry, this content isn't available right now
The link you followed may be broken, or the page may have been removed.
Sorry, that page doesn’t exist!
Nothing was found at this location. Try searching.
It looks like nothing was found at this location.
Whoops, looks like something went wrong.
Checking your browser before accessing the site.
Sorry, you have been blocked
Please verify you are a human
This website is using a security service to protect itself from online attacks.
Error 1020: Access denied
504 Gateway Time-out
429 Too Many Requests
HTTP Error 503. The service is unavailable.
HTTP Status 404 – Not Found
HTTP/1.1 401 Unauthorized
Bad Request - Invalid Hostname
Runtime Error: An application error occurred on the server.
Server Error in '/' Application.
Service Temporarily Unavailable
Proxy Error: The proxy server received an invalid response from an upstream server.
Your session has timed out. Please log in again.
Session expired, please sign in to continue.
You must be logged in to view this content.
You need to log in to view this page.
Login required
This account has been suspended.
JavaScript must be turned on to use this site.
You need to enable JavaScript to run this app.
Please enable JavaScript to view the comments powered by our system.
JavaScript is disabled in your browser.
It seems that JavaScript is turned off. Please turn it on for the full experience.
This page requires JavaScript.
Your browser does not support JavaScript!
Cookies must be enabled in order to log in.
Please turn on cookies and reload.
Please wait while your request is being verified...
Warning: mysql_connect(): Access denied for user 'root'@'localhost'
Fatal error: Call to undefined function get_header() in index.php on line 17
Parse error: syntax error, unexpected end of file in page.php on line 3
Notice: Undefined index: title in /home/www/list.php on line 40
Traceback (most recent call last):
java.lang.IllegalStateException: Cannot forward after response has been committed
Segmentation fault (core dumped)
TypeError: Cannot read property 'name' of undefined
ReferenceError: jQuery is not defined
Uncaught TypeError: $ is not a function
Hi [FIRSTNAME], we miss you.
Dear [Customer Name],
Dear ${customerFirstName}, thanks.
Hello {{contact.firstname}}, your parcel is ready.
Hi *|FNAME|*, here is our letter.
Dear %FIRST_NAME%, your bill is due.
Hello %%First Name%%!
Your order {order_number} has shipped.
Sincerely, [Your Name]
[Company Name] is proud to announce a new shop.
Meet us at <insert venue>.
<?php echo $title; ?>
{% if user.is_authenticated %} Welcome back {% endif %}
<%= link_to "Home", root_path %>
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
This is just a placeholder.
Replace this text with your own.
Add your description here
Enter your text here...
Your content goes here. Edit or remove this text inline.
Click to edit this text
Insert image here
Image coming soon
Sample page. This is an example page.
Just another WordPress site
[TODO: write conclusion]
FIXME
asdfasdf asdfasdf asdfasdf
foo bar foo bar foo bar
Hello undefined, welcome back!
Posted on Invalid Date
Price: NaN EUR
[object Object]
Total: null
By , on
Seite nicht gefunden
Die angeforderte Seite konnte nicht gefunden werden.
Diese Seite existiert leider nicht mehr.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.
Zugriff verweigert
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Ein unerwarteter Fehler ist aufgetreten.
Der Server ist vorübergehend nicht erreichbar.
Sie haben keine Berechtigung, diese Seite anzuzeigen.
Hier steht Ihr Text.
Page introuvable
La page que vous recherchez n'existe pas.
Cette page n'est plus disponible.
Une erreur est survenue. Veuillez réessayer plus tard.
Accès refusé
Votre session a expiré, veuillez vous reconnecter.
JavaScript est désactivé dans votre navigateur.
Vous devez activer JavaScript pour utiliser ce site.
Página no encontrada
La página que buscas no existe.
Se ha producido un error inesperado.
Acceso denegado
Su sesión ha caducado.
Debe habilitar JavaScript en su navegador.
Error interno del servidor
Pagina non trovata
La pagina richiesta non esiste.
Si è verificato un errore imprevisto.
Accesso negato
La sessione è scaduta, effettua di nuovo l'accesso.
Per utilizzare questo sito è necessario abilitare JavaScript.
Página não encontrada
Ocorreu um erro inesperado.
Pagina niet gevonden
Er is een fout opgetreden.
Schakel JavaScript in om deze site te gebruiken.
""".strip().splitlines()

LOOK_ALIKES = """
In Vue you write {{ title }} to print a value.
A 503 service unavailable reply is produced by the balancer.
When a browser gets a 404, it shows the page the server sent along.
The status code 429 was added in 2012.
Search engines treat a 410 as permanent and drop the page sooner.
She clicked the link and got an error, so she phoned the shop instead.
The museum's page about the wreck could use better pictures.
The lost page of the diary was not found until 1974.
Nobody could find the page where the recipe was written.
The committee found the report unavailable to most readers.
The file he was looking for lay under the sofa.
Access to the island is restricted during the breeding season.
The judge denied access to the sealed records.
He was refused entry because his visa had expired.
Parliament's session ended on Friday without a vote.
The session has a break at noon and ends with a song.
Her membership expired in March and she did not renew it.
JavaScript was designed in ten days in 1995.
JavaScript is required knowledge for most web jobs today.
The course teaches JavaScript and cookies are served at the break.
To enable cookies to rise, add a pinch of baking soda.
Scripts in the old library are kept in glass cases.
The film's script required three rewrites.
Turn on the oven and wait ten minutes.
Many sites nag you to enable JavaScript, which is annoying on old phones.
If a user disables JavaScript, the fallback form is posted to the server.
The noscript element shows its children when scripting is off.
Cicero's text, from which "lorem ipsum" comes, was written in 45 BC.
Printers have used lorem ipsum since the sixteenth century.
The phrase "page not found" has become a joke on T-shirts.
"Access denied", she read, and closed the laptop.
The sign said “No entry” and the gate was locked.
He muttered that something had gone wrong with the engine.
Something went wrong at the bakery, and the bread was late.
An unexpected error in the ledger cost the firm a fortune.
The error occurred to him only after the exam.
The maintenance of the bridge will take two years.
The road is under maintenance, so buses take the coast road.
The service was unavailable to villagers until the line was built.
He wrote TODO on the whiteboard and underlined it twice.
A to-do list helps me to get through the week.
The date of the wedding is to be announced in May.
The venue is still to be confirmed, the band told the paper.
In Python, None is the value of a function that returns nothing.
A null result is still a result, the editor wrote.
The treaty was declared null and void in 1920.
The slope is undefined where the curve is vertical.
NaN stands for "not a number" in floating-point arithmetic.
The log prints [object Object] because the value was never turned into text.
In SQL, null = null is not true.
Use printf("%s", name) to print a name in C.
The shell replaces ${HOME} with the path of your home directory.
In LaTeX, \\frac{a}{b} sets a fraction.
The set {1, 2, 3} has eight subsets.
Let f map {a, b} to {0, 1}.
The matrix entries a_{ij} are real.
He said [sic] that the data was fine.
[applause] Thank you all for coming.
The witness, @PERSON2, lived near @LOCATION1.
[crosstalk] and then we went home [laughter]
The author [Smith 2004] argues the opposite.
[Name withheld] told the court that he was afraid.
We thank [redacted] for the photographs.
The value of x << 2 is four times x.
if (a < b && c > d) return;
Cats chase mice; dogs chase cats; nobody chases dogs.
Bananas, bread, milk, eggs, flour, sugar
Home | News | Sport | Weather | Contact
The test, the second test and the third test all failed.
Blah, he thought, and went to sleep.
"Blah blah blah," said the bored student.
The dummy sat on the ventriloquist's knee.
A placeholder syllable such as "um" fills the pause.
Sample sizes were small and the text was short.
The text goes on to describe the siege.
Your story will appear in our spring issue, the editor promised me.
Please replace the filter every six months.
Insert the key and turn it gently.
Enter the hall and take the second door on the left.
Click the shutter halfway to focus.
The gateway to the valley is a narrow gorge.
A bad gateway on the campus was repaired last week.
Too many requests for help went unanswered that winter.
The bank limits how often you may try a password.
The traceback a debugger prints tells you which line failed.
A stack trace lists the calls that led to the exception.
Fatal errors in surgery are rare.
Syntax errors are the first thing a beginner meets.
An uncaught exception ends the process, the manual explains.
The connection was refused by the duke, who never married.
Database connections are pooled to save time.
Warning: strong currents, swim at your own risk.
Notice: the pool closes at eight.
Our server brought the soup and refused a tip.
The internal server of the tennis club is a volunteer.
In HTML, a page that is not found should return status 404.
A typical message reads: Access denied.
Users who see the words "session expired" should log in again.
The browser then says it cannot reach the page.
Die Seite des Buches war nicht mehr zu finden.
Er konnte die Seite nicht finden, auf der das Rezept stand.
Der Zugriff auf das Archiv wurde ihm 1950 verweigert.
Die Sitzung des Rates war um neun abgelaufen wie geplant.
Der Fehler ist erst beim Lesen aufgefallen.
La page arrachée du carnet reste introuvable depuis 1950.
L'accès à la grotte est interdit aux chiens, dit le guide.
La session d'examens commence en juin.
Une erreur de calcul est à l'origine du retard.
El acceso a la playa fue denegado por el alcalde.
La página del diario que falta no se ha encontrado nunca.
La sesión del parlamento duró nueve horas.
Un error en la cuenta costó caro al banco.
La pagina del manoscritto era illeggibile.
L'accesso al castello è chiuso in inverno.
La sessione di laurea si tiene a luglio.
A sessão do tribunal terminou tarde.
De pagina in het boek was gescheurd.
JavaScript wurde 1995 in zehn Tagen entworfen.
Le cours de JavaScript commence en octobre.
""".strip().splitlines()

# Written when the rules were done. 0.675 of them were found then, and none of the look-alikes; the rules were widened after that.
LATER_RESIDUE = """
This page isn’t working right now.
The owner of this website has banned your IP address.
Your request could not be processed. Please try again.
Invalid request.
The service you requested is currently unavailable.
We were unable to find the page you are looking for.
Error 521: Web server is down
502 Bad Gateway nginx/1.18.0
Forbidden: You don't have permission to access this resource.
Object moved to here.
The specified URL cannot be found.
The server is temporarily unable to service your request due to maintenance downtime.
Access to this resource on the server is denied!
Sorry, we couldn't find that page.
Please sign in to view this document.
Members only: please log in to read the rest.
Your browser has JavaScript disabled.
This application needs JavaScript to run.
Enable cookies and reload the page.
Hello {firstname}, we have news for you.
Dear <Your Name>,
Dear {{ customer.name }},
Hi {{first_name|there}}
Total due: ${invoice.total}
Welcome, %USER_NAME%
Posted by undefined on undefined
Lorem ipsum
Lorem ipsum dolor sit amet consectetur.
Add your text here.
Put your address here
[Insert date]
TODO: fill this in
ValueError: could not convert string to float: 'abc'
Warning: Undefined variable $x in /var/www/a.php on line 3
Exception in thread "main" java.lang.NullPointerException
Die Verbindung zum Server ist fehlgeschlagen.
Bitte melden Sie sich an, um diese Seite zu sehen.
Désolé, cette page n'existe pas.
Lo sentimos, la página no existe.
Spiacenti, la pagina non è stata trovata.
""".strip().splitlines()
LATER_LOOK_ALIKES = """
The bridge was closed and the detour could not be found on any map.
A page boy was not found at the castle.
The town's website has been moved to another company's care.
Our server at the restaurant was temporarily unavailable, so we waited.
The link between the two islands was broken by the storm.
You must log in the hours you worked by Friday.
He logged in at nine and left at five.
Please sign to confirm that the parcel arrived.
The account of the voyage is missing its last chapter.
Rates are limited to two calls a minute in the free plan.
Many programs print a stack trace when they crash.
In Django templates, {{ user }} prints the current user.
Write {{name}} in the Handlebars file to insert the name.
The word "undefined" confuses beginners.
An HTTP 500 is the server's fault, a 400 is the client's.
The nurse said the cookies were blocked from the ward.
Scripts are required reading for the actors.
The play requires scripts for twelve actors.
The lorem ipsum text has no meaning.
His dummy text messages fooled nobody.
We tested the test of the test.
The sample text of the treaty was sent to both kings.
To do this, mix flour and water.
The venue to be announced will hold 900 people.
Add the onions here and stir.
Put your coat here by the fire.
The doctor, to be appointed in May, will live here.
Null hypotheses are rejected at five percent.
None of the above applies.
Allergies: none
The variable i runs from {start} to {end} of the list.
A {2} b means two.
The Latin motto is "sic transit gloria mundi".
Errare humanum est, sed perseverare diabolicum.
Die Seite ist voller Fehler, sagt der Lehrer.
Der Server bringt das Essen an den Tisch.
La page est pleine de fautes.
El servicio de trenes fue interrumpido.
La sessione del consiglio è finita tardi.
Er was een fout in de krant.
""".strip().splitlines()

# Written after that; no rule was changed for them.
LAST_RESIDUE = """
The website cannot display the page.
Your account has been disabled.
This video is no longer available.
This post has been removed.
We could not find that page.
No page was found at this address.
Page Not Found | Our Shop
503 Backend fetch failed
500 - Internal server error.
You do not have permission to view this directory or page.
You must be logged in to reply to this topic.
Please log in to continue reading.
Your session has ended due to inactivity.
We have detected that JavaScript is disabled in your browser.
This site works best with JavaScript enabled.
Please turn JavaScript on and reload the page.
Warning: include(header.php): failed to open stream: No such file or directory in /srv/index.php on line 4
NullReferenceException: Object reference not set to an instance of an object.
KeyError: 'title'
Fatal error: Allowed memory size of 1 bytes exhausted
Hello {{user}}, you have {{count}} new messages.
Dear [First Name],
Your code is ${code}.
Ship to: {customer_address}
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.
This is a sample page.
Write a description here.
TBD
Updated: NaN days ago
Die Seite wurde nicht gefunden.
Cette page n'existe plus.
Esta página no existe.
Questa pagina non esiste più.
Deze pagina bestaat niet.
""".strip().splitlines()
LAST_LOOK_ALIKES = """
The page was torn and could not be read by the monks.
Our website has served the village since 1999.
The video of the wedding was lost in the fire.
The post was removed to make room for the gate.
We could not find the road in the fog.
The account was disabled by its owner, a retired clerk.
A session ended in uproar when the minister arrived.
Java, a script for shadow puppets, is enabled by lamps.
A page reported a server error, and the engineer restarted the machine.
If the key is missing, Python raises a KeyError.
Null references cost the industry a billion dollars, he claimed.
The title of the sample is on the page.
Write a letter to your aunt.
The days are long and the number is unknown.
Use {{ count }} in the Twig template to print the number.
She typed "page not found" into the search box.
He told me the site was down, so I went for a walk.
The access road is closed.
Nothing was found in the cave but bones.
The file cabinet is missing a drawer.
The address on the letter does not exist any more than the street does.
La página está en blanco porque el autor lo quiso así.
Die Seite mit dem Wappen fehlt im Buch.
La page de garde porte un nom effacé.
""".strip().splitlines()
