"""The 80 templates of the golden set, by class.

Text, expected action, critical or not, human score.
"""

TEMPLATES = {
    "DEVICE_HARDWARE_ISSUE": [
        ('@AppleSupport my phne screen is flickering green and black after i dropped it on carpet, is this covered?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport speaker at the bottom sounds like a tin can whenever playing music above 50% volume', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport battery health 76% on iphone 12, dies in 2 hours. need to know replacement cost', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport my charging port is loose cable just falls out when i plug it in pls help', 'AUTO_HANDLE', False, 4.3),
        ("@AppleSupport volume button stuck won't click at all on my iphone 13 pro", 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport camera lens has a crack across the 3x telephoto glass, photos are blurry', 'AUTO_HANDLE', False, 4.5),
        ("@AppleSupport left airpod won't charge in case even after cleaning pins with alcohol", 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport macbook trackpad is stiff and hard to press in the middle', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport back glass completely shattered on my 14 pro max, does apple care cover this?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport apple watch screen popped off the frame completely while charging!', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport my iphone battery exploded while on bedside table burned my hand and bed! my lawyer will contact you', 'ESCALATE', True, 5.0),
        ('@AppleSupport phone started smoking while charging with apple cable! melted the port completely', 'ESCALATE', True, 5.0),
        ("@AppleSupport you guys are scammers if you don't replace my broken screen for free i am suing apple in small claims court", 'ESCALATE', True, 5.0),
        ('@AppleSupport worst company on earth switching to samsung galaxy tomorrow your hardware is cheap garbage', 'ESCALATE', False, 4.8),
        ('@AppleSupport here is my serial and phone number 415-555-0199 call me immediately my screen is black', 'ESCALATE', True, 5.0),
        ('@AppleSupport email me at john.appleseed.test@gmail.com about replacing my swollen battery', 'ESCALATE', True, 5.0),
    ],
    "SOFTWARE_OS_BUG": [
        ('@AppleSupport updated to ios 17.2 and my battery is draining 20% an hour while idle wtf', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport stuck on black apple logo for past 45 mins after trying to update over wifi', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport bluetooth audio keeps cutting out every 10 secs in my car after update', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport safari keeps saying a problem repeatedly occurred with this webpage on all sites', 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport keyboard typing lag is horrible letters show up 3 seconds late on ios 17', 'AUTO_HANDLE', False, 4.5),
        ("@AppleSupport photos app stuck on 'curating best photos' and 'restoring from icloud' forever", 'AUTO_HANDLE', False, 4.2),
        ('@AppleSupport airplay icon disappeared from control center and cannot stream to apple tv', 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport instagram and tiktok keep crashing upon opening immediately on ios 17', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport wifi keeps dropping and asking for password every 15 minutes', 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport widgets on home screen are all blank gray squares after restart', 'AUTO_HANDLE', False, 4.2),
        ('@AppleSupport my device is acting weird and slow lately what should i do?', 'ESCALATE', False, 4.0),
        ('@AppleSupport things are not working right please fix this immediately', 'ESCALATE', False, 4.0),
        ('@AppleSupport ios 17 is absolute bullshit fuck you apple ruined my phone switching to pixel', 'ESCALATE', False, 4.9),
        ('@AppleSupport filing a formal complaint with FTC over forced battery throttling on older phones', 'ESCALATE', True, 5.0),
    ],
    "ACCOUNT_SECURITY_BILLING": [
        ("@AppleSupport unauthorized charge of $120 on my itunes receipt yesterday i didn't buy this!", 'ESCALATE', True, 5.0),
        ("@AppleSupport apple id is locked for security reasons and it won't accept my recovery key", 'ESCALATE', True, 5.0),
        ('@AppleSupport i was double charged for my icloud+ 2tb subscription this month refund please', 'ESCALATE', True, 5.0),
        ('@AppleSupport got an email saying someone signed into my apple id in moscow is this legit?', 'ESCALATE', True, 5.0),
        ('@AppleSupport someone changed the email on my apple account and stole my family organizer rights', 'ESCALATE', True, 5.0),
        ('@AppleSupport need refund for accidental in-app purchase my kid made on roblox', 'ESCALATE', True, 5.0),
        ("@AppleSupport can't receive 2fa verification code my old sim card is deactivated", 'ESCALATE', True, 5.0),
        ('@AppleSupport cancel my apple music subscription immediately and refund last 3 months', 'ESCALATE', True, 5.0),
        ('@AppleSupport my card 4532-0150-1234-5678 was charged $49.99 unauthorized cancel it now!', 'ESCALATE', True, 5.0),
        ("@AppleSupport password is: SecretP@ss123 why can't i log in to icloud???", 'ESCALATE', True, 5.0),
        ('@AppleSupport contact my email sarah.connor.tech@gmail.com about fraudulent itunes bill', 'ESCALATE', True, 5.0),
        ('@AppleSupport call me on 212-555-0144 my ssn is 000-12-3456 someone opened apple card under my name', 'ESCALATE', True, 5.0),
    ],
    "HOW_TO_CONFIGURATION": [
        ('@AppleSupport how do i enable airdrop so anyone nearby can send me a pdf document?', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport how do i set up automatic dark mode to turn on when the sun goes down?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport how do i transfer all data from old iphone to new iphone 15 with quick start?', 'AUTO_HANDLE', False, 4.7),
        ('@AppleSupport how do i turn on icloud backup so my messages and photos are saved safely?', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport how do i pair my airpods pro with my macbook pro bluetooth?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport how do i set up family sharing so my kids can share my icloud storage?', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport how do i configure do not disturb or focus mode while driving?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport how do i change the default web browser to chrome on ios 17?', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport how do i turn off personalized ads and app tracking transparency?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport how do i use standby mode on iphone 14 pro on nightstand?', 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport yo how do i trn on dark mode my eyes r burning lol', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport hw do i airdrop pic to frend who isnt in cntacts', 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport send the setup instructions to my personal email test.user123@yahoo.com', 'ESCALATE', True, 5.0),
        ('@AppleSupport my phone is 312-555-0188 text me how to setup my apple watch', 'ESCALATE', True, 5.0),
    ],
    "ORDER_DELIVERY_STATUS": [
        ('@AppleSupport ordered iphone 15 pro last friday how do i track delivery status?', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport can my brother pick up my apple store online order if i add his name?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport ups tracking says package delivered to porch but there is no box outside', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport can i change shipping address for my macbook after it has dispatched?', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport where do i find my web order number to check trade-in kit delivery?', 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport apple store app says order processing for 5 days when will it ship?', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport can i return an online order to a physical apple retail store?', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport how long will the apple store hold my in-store pickup order before canceling?', 'AUTO_HANDLE', False, 4.4),
        ("@AppleSupport wheres my iphone delivery ordered 3 days ago order status page won't load", 'AUTO_HANDLE', False, 4.3),
        ('@AppleSupport fedex delayed my mac delivery again can apple expedite this?', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport order never arrived you stole my money! filing credit card chargeback and legal complaint', 'ESCALATE', True, 5.0),
        ('@AppleSupport tracking for card 4000-1234-5678-9010 order delivery update please', 'ESCALATE', True, 5.0),
    ],
    "CHITCHAT_OUT_OF_SCOPE": [
        ('@AppleSupport the camera on 15 pro is insane just filmed my entire short film on it!', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport good morning apple support team hope you have a great day today!', 'AUTO_HANDLE', False, 4.6),
        ('@AppleSupport tell tim cook i love the new titanium design on the pro models', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport why did the iphone wear sunglasses? because it had too many bright ideas lol', 'AUTO_HANDLE', False, 4.5),
        ('@AppleSupport siri just told me a hilarious joke love this feature haha', 'AUTO_HANDLE', False, 4.4),
        ('@AppleSupport android is 100x better than ios enjoy your overpriced bricks', 'AUTO_HANDLE', False, 4.0),
        ('@AppleSupport playlist on apple music today is pure fire who curates this?', 'AUTO_HANDLE', False, 4.3),
        ("@AppleSupport what's the weather like at apple park in cupertino right now?", 'AUTO_HANDLE', False, 4.2),
        ('@AppleSupport hire me as an ios developer my portfolio is at developer-dan.io', 'AUTO_HANDLE', False, 4.0),
        ('@AppleSupport what is apple stock price going to be at the end of the year?', 'AUTO_HANDLE', False, 4.1),
        ('@AppleSupport fuck tim cook and your greedy trash corporation', 'ESCALATE', False, 4.9),
        ('@AppleSupport i will personally sue apple for brain damage from 5g radiation!', 'ESCALATE', True, 5.0),
    ],
}
