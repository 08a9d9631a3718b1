"""Word counts of whole licence texts (lower case, "word count" pairs), made from the texts of the licences."""

# fmt: off
WHOLE = (
    ("MIT", "mit 1 license 1 copyright 3 c 1 permission 2 is 4 hereby 1 granted 1 free 1 of 8 charge 1 to 8 any 3 person 1 obtaining 1 a 2 copy 2 this 2 software 9 and 5 associated 1 documentation 1 files 1 the 14 deal 1 in 6 without 3 restriction 1 including 2 limitation 1 rights 1 use 2 modify 1 merge 1 publish 1 distribute 1 sublicense 1 or 9 sell 1 copies 2 permit 1 persons 1 whom 1 furnished 1 do 1 so 1 subject 1 following 1 conditions 1 above 1 notice 2 shall 2 be 2 included 1 all 1 substantial 1 portions 1 provided 1 as 1 warranty 1 kind 1 express 1 implied 1 but 1 not 1 limited 1 warranties 1 merchantability 1 fitness 1 for 2 particular 1 purpose 1 noninfringement 1 no 1 event 1 authors 1 holders 1 liable 1 claim 1 damages 1 other 2 liability 1 whether 1 an 1 action 1 contract 1 tort 1 otherwise 1 arising 1 from 1 out 1 connection 1 with 1 dealings 1"),
    ("BSD-2-Clause", "copyright 5 c 1 all 1 rights 1 reserved 1 redistribution 1 and 9 use 3 in 6 source 2 binary 2 forms 1 with 2 or 10 without 1 modification 1 are 3 permitted 1 provided 3 that 1 the 12 following 3 conditions 3 met 1 1 1 redistributions 2 of 11 code 1 must 2 retain 1 above 2 notice 2 this 4 list 2 disclaimer 2 2 1 form 1 reproduce 1 documentation 1 other 1 materials 1 distribution 1 software 2 is 2 by 1 holders 1 contributors 2 as 1 any 4 express 1 implied 2 warranties 2 including 3 but 2 not 2 limited 2 to 2 merchantability 1 fitness 1 for 2 a 1 particular 1 purpose 1 disclaimed 1 no 1 event 1 shall 1 holder 1 be 1 liable 1 direct 1 indirect 1 incidental 1 special 1 exemplary 1 consequential 1 damages 1 procurement 1 substitute 1 goods 1 services 1 loss 1 data 1 profits 1 business 1 interruption 1 however 1 caused 1 on 1 theory 1 liability 2 whether 1 contract 1 strict 1 tort 1 negligence 1 otherwise 1 arising 1 way 1 out 1 even 1 if 1 advised 1 possibility 1 such 1 damage 1"),
    ("BSD-3-Clause", "copyright 6 c 1 all 1 rights 1 reserved 1 redistribution 1 and 9 use 3 in 6 source 2 binary 2 forms 1 with 2 or 11 without 2 modification 1 are 3 permitted 1 provided 3 that 1 the 15 following 3 conditions 3 met 1 1 1 redistributions 2 of 13 code 1 must 2 retain 1 above 2 notice 2 this 5 list 2 disclaimer 2 2 1 form 1 reproduce 1 documentation 1 other 1 materials 1 distribution 1 3 1 neither 1 name 1 holder 2 nor 1 names 1 its 1 contributors 3 may 1 be 2 used 1 to 3 endorse 1 promote 1 products 1 derived 1 from 1 software 3 specific 1 prior 1 written 1 permission 1 is 2 by 1 holders 1 as 1 any 4 express 1 implied 2 warranties 2 including 3 but 2 not 2 limited 2 merchantability 1 fitness 1 for 2 a 1 particular 1 purpose 1 disclaimed 1 no 1 event 1 shall 1 liable 1 direct 1 indirect 1 incidental 1 special 1 exemplary 1 consequential 1 damages 1 procurement 1 substitute 1 goods 1 services 1 loss 1 data 1 profits 1 business 1 interruption 1 however 1 caused 1 on 1 theory 1 liability 2 whether 1 contract 1 strict 1 tort 1 negligence 1 otherwise 1 arising 1 way 1 out 1 even 1 if 1 advised 1 possibility 1 such 1 damage 1"),
    ("ISC", "isc 1 license 1 copyright 2 c 1 permission 2 to 2 use 3 copy 1 modify 1 and 4 or 8 distribute 1 this 4 software 4 for 2 any 3 purpose 1 with 3 without 1 fee 1 is 3 hereby 1 granted 1 provided 2 that 1 the 5 above 1 notice 2 appear 1 in 4 all 3 copies 1 as 1 author 2 disclaims 1 warranties 2 regard 1 including 1 implied 1 of 5 merchantability 1 fitness 1 no 1 event 1 shall 1 be 1 liable 1 special 1 direct 1 indirect 1 consequential 1 damages 2 whatsoever 1 resulting 1 from 1 loss 1 data 1 profits 1 whether 1 an 1 action 2 contract 1 negligence 1 other 1 tortious 1 arising 1 out 1 connection 1 performance 1"),
    ("Unlicense", "this 6 is 4 free 2 and 7 unencumbered 1 software 8 released 1 into 1 the 13 public 3 domain 2 anyone 1 to 7 copy 1 modify 1 publish 1 use 2 compile 1 sell 1 or 10 distribute 1 either 1 in 8 source 1 code 1 form 1 as 2 a 2 compiled 1 binary 1 for 5 any 5 purpose 2 commercial 2 non 1 by 1 means 1 jurisdictions 1 that 1 recognize 1 copyright 3 laws 1 author 1 authors 2 of 9 dedicate 1 all 2 interest 1 we 2 make 1 dedication 2 benefit 1 at 1 large 1 detriment 1 our 1 heirs 1 successors 1 intend 1 be 2 an 2 overt 1 act 1 relinquishment 1 perpetuity 1 present 1 future 1 rights 1 under 1 law 1 provided 1 without 1 warranty 1 kind 1 express 1 implied 1 including 1 but 1 not 1 limited 1 warranties 1 merchantability 1 fitness 1 particular 1 noninfringement 1 no 1 event 1 shall 1 liable 1 claim 1 damages 1 other 2 liability 1 whether 1 action 1 contract 1 tort 1 otherwise 1 arising 1 from 1 out 1 connection 1 with 1 dealings 1 more 1 information 1 please 1 refer 1 unlicense 1 org 1"),
    ("Apache-2.0", "apache 6 license 35 version 3 2 4 0 3 january 1 2004 1 http 2 www 2 org 2 licenses 3 terms 9 and 46 conditions 13 for 24 use 10 reproduction 4 distribution 5 1 2 definitions 1 shall 15 mean 10 the 100 as 17 defined 1 by 23 sections 1 through 1 9 2 of 67 this 17 document 1 licensor 10 copyright 13 owner 6 or 69 entity 10 authorized 2 that 22 is 10 granting 1 legal 5 union 1 acting 1 all 3 other 7 entities 1 control 4 are 6 controlled 1 under 9 common 1 with 11 purposes 4 definition 2 means 2 i 1 power 1 direct 3 indirect 2 to 40 cause 2 direction 1 management 1 such 18 whether 4 contract 2 otherwise 6 ii 1 ownership 2 fifty 1 percent 1 50 1 more 1 outstanding 1 shares 1 iii 1 beneficial 1 you 26 your 13 an 7 individual 3 exercising 1 permissions 3 granted 2 source 12 form 13 preferred 1 making 1 modifications 6 including 9 but 5 not 12 limited 4 software 2 code 3 documentation 3 configuration 1 files 3 object 6 any 30 resulting 1 from 5 mechanical 1 transformation 1 translation 1 a 22 compiled 1 generated 2 conversions 1 media 1 types 1 work 34 authorship 3 in 24 made 2 available 1 indicated 1 notice 9 included 2 attached 1 example 1 provided 5 appendix 2 below 1 derivative 18 works 19 based 1 on 11 derived 1 which 2 editorial 1 revisions 1 annotations 1 elaborations 1 represent 1 whole 2 original 2 include 3 remain 1 separable 1 merely 1 link 1 bind 1 name 3 interfaces 1 thereof 4 contribution 8 additions 1 intentionally 2 submitted 4 inclusion 2 submit 1 behalf 5 electronic 2 verbal 1 written 1 communication 3 sent 1 its 3 representatives 1 mailing 1 lists 1 systems 2 issue 1 tracking 1 managed 1 purpose 3 discussing 1 improving 1 excluding 3 conspicuously 1 marked 1 designated 1 writing 4 contributor 10 whom 1 has 2 been 2 received 1 subsequently 1 incorporated 2 within 8 grant 3 subject 2 each 4 hereby 2 grants 2 perpetual 2 worldwide 2 non 3 exclusive 2 no 4 charge 3 royalty 2 free 2 irrevocable 2 reproduce 2 prepare 1 publicly 2 display 2 perform 1 sublicense 1 distribute 5 3 1 patent 7 except 3 stated 2 section 1 make 1 have 2 offer 2 sell 2 import 1 transfer 1 where 1 applies 1 only 4 those 3 claims 2 licensable 1 necessarily 1 infringed 1 their 2 s 3 alone 1 combination 1 was 1 if 6 institute 1 litigation 2 against 2 cross 1 claim 1 counterclaim 1 lawsuit 1 alleging 1 constitutes 1 contributory 1 infringement 2 then 2 terminate 1 date 1 filed 1 4 1 redistribution 1 may 9 copies 1 medium 1 without 5 meet 1 following 3 must 4 give 1 recipients 1 copy 3 b 1 modified 1 carry 1 prominent 1 notices 8 stating 1 changed 1 c 1 retain 1 trademark 1 attribution 4 do 3 pertain 2 part 4 d 1 includes 1 text 4 file 8 readable 1 contained 1 at 2 least 1 one 1 places 1 distributed 3 along 1 wherever 1 third 2 party 2 normally 1 appear 1 contents 1 informational 1 modify 2 add 2 own 4 alongside 1 addendum 1 additional 5 cannot 1 be 5 construed 1 modifying 1 statement 1 provide 1 different 1 complies 1 5 1 submission 1 contributions 3 unless 4 explicitly 1 state 1 notwithstanding 1 above 1 nothing 1 herein 1 supersede 1 separate 1 agreement 1 executed 1 regarding 1 6 1 trademarks 2 does 1 permission 1 trade 1 names 2 service 1 marks 1 product 1 required 4 reasonable 1 customary 1 describing 1 origin 1 reproducing 1 content 1 7 1 disclaimer 1 warranty 4 applicable 3 law 3 agreed 3 provides 2 basis 2 warranties 3 kind 2 either 2 express 2 implied 2 limitation 2 title 1 merchantability 1 fitness 1 particular 1 solely 1 responsible 1 determining 1 appropriateness 1 using 1 redistributing 2 assume 1 risks 1 associated 1 exercise 1 8 1 liability 5 event 1 theory 1 tort 1 negligence 1 deliberate 1 grossly 1 negligent 1 acts 1 liable 1 damages 5 special 1 incidental 1 consequential 1 character 1 arising 1 result 1 out 1 inability 1 loss 1 goodwill 1 stoppage 1 computer 1 failure 1 malfunction 1 commercial 1 losses 1 even 1 advised 1 possibility 1 accepting 3 while 1 choose 1 fee 1 acceptance 1 support 1 indemnity 1 obligations 2 rights 1 consistent 1 however 1 act 1 sole 1 responsibility 1 agree 1 indemnify 1 defend 1 hold 1 harmless 1 incurred 1 asserted 1 reason 1 end 1 how 1 apply 2 attach 1 boilerplate 1 fields 1 enclosed 2 brackets 2 replaced 1 identifying 1 information 1 don 1 t 1 should 1 appropriate 1 comment 1 syntax 1 format 1 we 1 also 1 recommend 1 class 1 description 1 same 1 printed 1 page 1 easier 1 identification 1 archives 1 yyyy 1 licensed 1 compliance 1 obtain 1 see 1 specific 1 language 1 governing 1 limitations 1"),
    ("GPL-2.0", "gnu 8 general 15 public 16 license 46 version 13 2 8 june 1 1991 2 copyright 14 c 8 1989 2 free 28 software 35 foundation 10 inc 3 51 2 franklin 2 street 2 fifth 2 floor 2 boston 2 ma 2 02110 2 1301 2 usa 2 everyone 4 is 53 permitted 4 to 108 copy 18 and 72 distribute 19 verbatim 3 copies 8 of 104 this 49 document 1 but 7 changing 1 it 39 not 34 allowed 2 preamble 1 the 194 licenses 4 for 39 most 4 are 13 designed 2 take 1 away 1 your 20 freedom 4 share 2 change 5 by 28 contrast 1 intended 4 guarantee 1 make 9 sure 3 all 14 its 7 users 2 applies 3 s 5 any 38 other 18 program 71 whose 3 authors 2 commit 1 using 1 some 1 covered 3 lesser 2 instead 2 you 76 can 8 apply 6 programs 6 too 2 when 7 we 9 speak 1 referring 1 price 1 our 3 that 35 have 11 charge 5 service 1 if 32 wish 3 receive 4 source 16 code 16 or 77 get 3 want 5 use 9 pieces 1 in 29 new 6 know 3 do 8 these 11 things 1 protect 2 rights 11 need 2 restrictions 3 forbid 1 anyone 1 deny 1 ask 2 surrender 1 translate 1 certain 4 responsibilities 1 modify 9 example 2 such 12 a 57 whether 3 gratis 1 fee 3 must 9 give 4 recipients 4 they 6 show 8 them 3 terms 18 so 8 their 2 with 17 two 2 steps 1 1 7 offer 5 which 10 gives 1 legal 1 permission 3 also 5 each 8 author 5 protection 2 ours 1 understands 1 there 3 no 8 warranty 13 modified 4 someone 1 else 3 passed 1 on 26 what 5 original 4 problems 2 introduced 1 others 1 will 8 reflect 1 reputations 1 finally 1 threatened 1 constantly 1 patents 3 avoid 1 danger 1 redistributors 1 individually 1 obtain 1 patent 5 effect 1 making 2 proprietary 3 prevent 1 made 4 clear 2 be 16 licensed 4 at 8 precise 1 conditions 13 copying 4 distribution 16 modification 4 follow 1 0 1 work 24 contains 3 notice 6 placed 1 holder 4 saying 2 may 17 distributed 7 under 19 below 1 refers 1 based 12 means 3 either 7 derivative 3 law 4 say 1 containing 1 portion 3 modifications 3 translated 1 into 3 another 2 language 1 hereinafter 1 translation 1 included 1 without 4 limitation 3 term 1 licensee 2 addressed 1 as 21 activities 1 than 3 outside 1 scope 2 act 2 running 3 restricted 2 output 2 from 10 only 5 contents 1 constitute 1 independent 2 having 1 been 2 true 1 depends 1 does 6 medium 4 provided 4 conspicuously 1 appropriately 1 publish 3 an 9 appropriate 3 disclaimer 2 keep 1 intact 1 notices 3 refer 1 absence 1 along 3 physical 1 transferring 1 option 3 exchange 1 thus 4 forming 1 section 9 above 6 meet 1 cause 3 files 3 carry 1 prominent 1 stating 1 changed 1 date 1 b 3 whole 7 part 4 derived 2 thereof 1 third 5 parties 7 normally 3 reads 1 commands 3 interactively 1 run 1 started 1 interactive 4 ordinary 1 way 3 print 3 display 1 announcement 3 including 4 provide 2 redistribute 6 telling 1 user 1 how 3 view 1 exception 2 itself 2 required 3 requirements 1 identifiable 1 sections 6 reasonably 1 considered 1 separate 2 works 5 themselves 1 then 4 those 3 same 2 permissions 1 licensees 1 extend 1 entire 2 every 1 regardless 1 who 5 wrote 1 intent 2 claim 1 contest 2 written 4 entirely 2 rather 1 exercise 2 right 2 control 2 collective 1 addition 1 mere 1 aggregation 1 volume 1 storage 1 bring 1 3 1 object 4 executable 7 form 4 one 2 following 3 accompany 3 complete 3 corresponding 3 machine 2 readable 2 customarily 2 used 3 interchange 2 valid 1 least 2 three 1 years 1 party 3 more 3 cost 2 physically 1 performing 1 information 2 received 4 alternative 1 noncommercial 1 accord 1 subsection 1 preferred 1 modules 1 plus 2 associated 1 interface 1 definition 1 scripts 1 compilation 1 installation 1 however 3 special 2 include 1 anything 1 binary 1 major 1 components 1 compiler 1 kernel 1 operating 1 system 5 runs 1 unless 2 component 1 accompanies 1 offering 2 access 2 designated 1 place 2 equivalent 1 counts 1 even 4 though 1 compelled 1 4 1 sublicense 2 except 2 expressly 1 attempt 1 otherwise 3 void 1 automatically 2 terminate 1 terminated 1 long 1 remain 1 full 2 compliance 2 5 1 accept 2 since 1 signed 1 nothing 1 grants 1 actions 1 prohibited 1 therefore 1 modifying 2 distributing 2 indicate 1 acceptance 1 6 1 time 3 recipient 1 receives 1 licensor 1 subject 1 impose 2 further 1 granted 1 herein 1 responsible 1 enforcing 1 7 1 consequence 3 court 2 judgment 1 allegation 1 infringement 1 reason 1 limited 3 issues 1 imposed 1 order 1 agreement 1 contradict 1 excuse 1 cannot 2 satisfy 2 simultaneously 1 obligations 2 pertinent 1 would 2 permit 3 royalty 1 redistribution 1 directly 1 indirectly 1 through 3 could 2 both 1 refrain 1 held 1 invalid 1 unenforceable 1 particular 3 circumstance 1 balance 1 circumstances 1 purpose 4 induce 1 infringe 1 property 1 claims 2 validity 1 has 2 sole 1 protecting 1 integrity 1 implemented 1 practices 1 many 1 people 1 generous 1 contributions 1 wide 1 range 1 reliance 1 consistent 1 application 1 up 1 donor 1 decide 1 he 1 she 1 willing 1 choice 1 thoroughly 1 believed 1 rest 1 8 1 countries 3 copyrighted 2 interfaces 1 places 1 add 2 explicit 1 geographical 1 excluding 1 among 1 excluded 1 case 1 incorporates 1 body 1 9 1 revised 1 versions 2 similar 1 spirit 1 present 1 differ 1 detail 1 address 1 concerns 1 given 1 distinguishing 1 number 3 specifies 1 later 3 published 3 specify 1 choose 1 ever 1 10 1 incorporate 1 parts 2 different 1 write 3 sometimes 1 exceptions 1 decision 1 guided 1 goals 1 preserving 1 status 1 derivatives 1 promoting 1 sharing 1 reuse 1 generally 1 11 1 because 1 extent 1 applicable 2 stated 1 writing 2 holders 1 kind 1 expressed 1 implied 3 warranties 1 merchantability 2 fitness 2 risk 1 quality 1 performance 1 should 5 prove 1 defective 1 assume 1 necessary 2 servicing 1 repair 1 correction 1 12 1 event 1 agreed 1 liable 1 damages 3 incidental 1 consequential 1 arising 1 out 1 inability 1 loss 1 data 2 being 1 rendered 1 inaccurate 1 losses 1 sustained 1 failure 1 operate 1 advised 1 possibility 1 end 1 develop 1 greatest 1 possible 1 best 1 achieve 1 attach 2 safest 1 start 1 file 2 effectively 1 convey 1 exclusion 1 line 2 pointer 1 where 1 found 1 name 3 brief 1 idea 1 year 2 hope 1 useful 2 see 1 details 3 contact 1 electronic 1 paper 1 mail 1 short 1 like 1 starts 1 mode 1 gnomovision 3 69 1 comes 1 absolutely 1 type 2 w 3 welcome 1 hypothetical 1 course 1 called 1 something 1 mouse 1 clicks 1 menu 1 items 1 whatever 1 suits 1 employer 1 programmer 1 school 1 sign 1 here 1 sample 1 alter 1 names 1 yoyodyne 1 hereby 1 disclaims 1 interest 1 makes 1 passes 1 compilers 1 james 1 hacker 1 signature 1 ty 2 coon 2 april 1 president 1 vice 1 incorporating 1 subroutine 1 library 2 consider 1 linking 1 applications 1"),
    ("GPL-3.0", "gnu 22 general 23 public 25 license 102 version 25 3 6 29 1 june 1 2007 3 copyright 30 c 8 free 20 software 27 foundation 6 inc 1 https 4 fsf 1 org 4 everyone 2 is 70 permitted 5 to 192 copy 25 and 98 distribute 5 verbatim 3 copies 14 of 221 this 86 document 3 but 16 changing 1 it 52 not 51 allowed 3 preamble 1 the 345 a 184 copyleft 1 for 86 other 30 kinds 2 works 12 licenses 9 most 5 practical 1 are 28 designed 6 take 1 away 1 your 34 freedom 8 share 2 change 5 by 43 contrast 1 intended 1 guarantee 1 all 21 versions 14 program 52 make 14 sure 3 remains 3 its 10 users 9 we 7 use 24 our 2 applies 2 also 7 any 50 work 97 released 2 way 7 authors 7 you 128 can 13 apply 14 programs 6 too 2 when 7 speak 1 referring 1 price 4 that 91 have 14 charge 8 them 8 if 49 wish 2 receive 8 source 42 code 34 or 151 get 4 want 3 pieces 1 in 81 new 7 know 2 do 16 these 10 things 1 protect 3 rights 19 need 5 prevent 2 others 4 from 29 denying 1 asking 1 surrender 2 therefore 4 certain 4 responsibilities 2 modify 12 respect 2 example 5 such 21 whether 5 gratis 2 fee 4 must 14 pass 1 on 31 recipients 7 same 5 freedoms 1 received 8 they 6 show 6 terms 32 so 11 their 6 developers 3 gpl 7 with 45 two 1 steps 1 1 6 assert 1 2 6 offer 8 giving 2 legal 11 permission 10 protection 2 clearly 1 explains 1 there 3 no 17 warranty 15 both 2 sake 1 requires 1 modified 13 be 29 marked 2 as 38 changed 1 problems 3 will 8 attributed 1 erroneously 1 previous 2 some 7 devices 1 deny 1 access 6 install 4 run 8 inside 1 although 1 manufacturer 1 fundamentally 1 incompatible 1 aim 1 protecting 2 systematic 1 pattern 1 abuse 1 occurs 2 area 1 products 3 individuals 2 which 21 precisely 1 where 5 unacceptable 1 prohibit 2 practice 2 those 14 arise 1 substantially 2 domains 2 stand 1 ready 1 extend 2 provision 3 future 2 needed 3 finally 2 every 1 threatened 1 constantly 1 patents 6 states 1 should 6 allow 1 restrict 1 development 1 purpose 5 computers 1 avoid 1 special 4 danger 1 applied 1 could 3 effectively 2 proprietary 3 assures 1 cannot 3 used 12 render 1 non 9 precise 1 conditions 14 copying 4 distribution 5 modification 6 follow 3 0 1 definitions 1 refers 3 means 18 like 2 laws 2 semiconductor 1 masks 1 copyrightable 1 licensed 3 under 44 each 10 licensee 1 addressed 1 licensees 2 may 31 organizations 2 adapt 1 part 10 fashion 1 requiring 4 than 4 making 8 an 26 exact 1 resulting 3 called 3 earlier 2 based 6 covered 41 either 9 unmodified 3 propagate 9 anything 4 without 7 would 7 directly 2 secondarily 1 liable 2 infringement 3 applicable 9 law 10 except 4 executing 1 computer 2 modifying 2 private 1 propagation 4 includes 4 available 9 countries 1 activities 3 well 1 convey 26 kind 2 enables 1 parties 8 mere 1 interaction 3 user 15 through 4 network 8 transfer 1 conveying 15 interactive 4 interface 7 displays 2 appropriate 8 notices 11 extent 6 convenient 1 prominently 1 visible 1 feature 1 notice 8 tells 1 warranties 2 provided 13 how 6 view 1 presents 1 list 2 commands 3 options 1 menu 1 prominent 3 item 1 meets 1 criterion 1 preferred 1 form 11 modifications 3 object 21 standard 3 official 1 defined 1 recognized 1 standards 1 body 1 case 2 interfaces 3 specified 2 particular 10 programming 1 language 2 one 7 widely 1 among 1 working 1 system 5 libraries 3 executable 3 include 6 whole 3 included 3 normal 1 packaging 1 major 5 component 5 b 6 serves 1 only 8 enable 1 implement 1 implementation 2 context 1 essential 3 kernel 1 window 1 specific 3 operating 1 runs 1 compiler 1 produce 2 interpreter 1 corresponding 23 generate 1 including 8 scripts 1 control 6 however 6 does 13 s 12 tools 1 generally 1 performing 2 definition 2 files 4 associated 1 shared 1 dynamically 1 linked 1 subprograms 2 specifically 3 require 5 intimate 1 data 3 communication 2 flow 1 between 1 parts 6 regenerate 1 automatically 4 basic 1 permissions 10 granted 7 term 4 irrevocable 1 stated 5 met 1 explicitly 2 affirms 1 unlimited 1 output 3 running 3 given 3 content 1 constitutes 1 acknowledges 1 fair 1 equivalent 3 long 3 otherwise 6 force 1 sole 1 having 2 exclusively 2 provide 5 facilities 2 comply 1 material 13 thus 2 behalf 1 direction 1 copyrighted 1 outside 1 relationship 1 circumstances 1 solely 3 below 1 sublicensing 1 section 15 10 4 makes 1 unnecessary 1 anti 1 circumvention 5 shall 5 deemed 1 effective 1 technological 3 measure 1 fulfilling 1 obligations 4 article 1 11 3 wipo 1 treaty 1 adopted 1 20 1 december 1 1996 1 similar 2 prohibiting 2 restricting 1 measures 3 waive 1 power 1 forbid 2 effected 1 exercising 1 disclaim 1 intention 1 limit 2 operation 2 enforcing 2 against 2 third 9 4 4 medium 6 conspicuously 1 appropriately 1 publish 2 keep 3 intact 3 stating 4 permissive 4 added 3 accord 4 7 4 absence 1 give 6 along 5 support 3 5 2 meet 1 carry 2 relevant 2 date 1 requirement 5 modifies 2 entire 4 anyone 4 who 8 comes 2 into 5 possession 3 additional 14 regardless 5 packaged 1 gives 1 invalidate 1 separately 3 d 3 has 9 display 2 compilation 3 separate 1 independent 1 nature 1 extensions 1 combined 2 larger 1 volume 1 storage 1 aggregate 3 beyond 1 what 4 individual 2 permit 3 inclusion 1 cause 2 6 1 forms 1 sections 3 machine 1 readable 1 ways 2 embodied 2 physical 6 product 21 accompanied 3 fixed 2 durable 2 customarily 2 interchange 2 written 4 valid 4 at 8 least 2 three 2 years 1 spare 1 customer 1 model 1 possesses 1 more 7 reasonable 6 cost 2 physically 1 server 5 alternative 1 occasionally 1 noncommercially 1 subsection 2 6b 1 offering 2 designated 1 place 5 further 8 different 4 operated 1 party 12 supports 1 maintain 1 clear 1 directions 1 next 1 saying 1 find 2 hosts 1 remain 1 obligated 1 ensure 2 satisfy 3 requirements 5 e 2 using 4 peer 4 transmission 2 inform 1 peers 1 being 2 offered 1 6d 1 separable 1 portion 2 whose 1 excluded 1 library 3 consumer 4 tangible 1 personal 2 property 1 normally 2 family 1 household 1 purposes 3 sold 1 incorporation 1 dwelling 1 determining 1 doubtful 1 cases 2 resolved 1 favor 1 coverage 2 typical 1 common 1 class 1 status 1 actually 1 uses 3 expects 1 expected 1 substantial 1 commercial 1 industrial 1 unless 5 represent 1 significant 1 mode 2 installation 4 information 8 methods 1 procedures 1 authorization 1 keys 1 required 4 execute 1 suffice 1 continued 1 functioning 1 prevented 1 interfered 1 because 1 been 6 made 2 transaction 7 right 3 transferred 1 recipient 5 perpetuity 1 characterized 1 conveyed 3 neither 1 nor 1 retains 1 ability 1 installed 3 rom 1 continue 2 service 2 updates 1 denied 1 itself 1 materially 1 adversely 1 affects 1 violates 1 rules 1 protocols 1 across 1 format 1 publicly 2 documented 1 password 1 key 1 unpacking 1 reading 1 supplement 2 exceptions 2 treated 1 though 1 were 1 governed 3 regard 1 option 3 remove 2 own 1 removal 1 notwithstanding 2 add 4 authorized 1 holders 2 disclaiming 1 limiting 3 liability 7 differently 1 15 3 16 3 preservation 1 author 4 attributions 1 displayed 1 containing 1 misrepresentation 1 origin 1 original 2 publicity 1 names 2 licensors 4 declining 1 grant 5 trademark 1 trade 1 trademarks 1 marks 1 f 1 indemnification 1 conveys 2 contractual 2 assumptions 2 impose 3 considered 1 restrictions 2 within 2 meaning 1 contains 2 restriction 3 permits 1 relicensing 2 survive 1 statement 2 indicating 1 above 3 8 1 termination 2 expressly 1 attempt 1 void 1 terminate 2 patent 23 paragraph 2 cease 1 violation 5 then 4 holder 10 reinstated 3 provisionally 1 until 1 terminates 1 permanently 4 fails 1 notify 1 prior 3 60 1 days 2 after 2 cessation 1 moreover 1 notifies 1 first 2 time 4 cure 1 30 1 receipt 1 terminated 1 qualify 1 9 1 acceptance 4 accept 2 order 2 ancillary 1 occurring 1 consequence 3 likewise 1 nothing 2 grants 3 actions 1 infringe 2 propagating 1 indicate 1 automatic 1 licensing 1 downstream 2 receives 3 subject 1 responsible 1 compliance 1 entity 2 transferring 1 organization 2 assets 1 subdividing 1 merging 1 results 1 whatever 1 predecessor 3 interest 2 had 1 plus 1 efforts 1 exercise 4 affirmed 1 royalty 3 initiate 1 litigation 1 cross 1 claim 2 counterclaim 1 lawsuit 1 alleging 1 infringed 3 selling 2 sale 2 importing 1 contributor 10 authorizes 2 claims 4 owned 1 controlled 1 already 1 acquired 2 hereafter 1 manner 3 sublicenses 1 consistent 2 exclusive 1 worldwide 1 sell 1 import 1 contents 1 following 3 paragraphs 1 express 2 agreement 3 commitment 2 denominated 1 enforce 2 covenant 1 sue 1 knowingly 2 relying 2 readily 1 accessible 1 arrange 2 deprive 1 yourself 1 benefit 1 actual 1 knowledge 1 country 3 identifiable 1 reason 1 believe 1 pursuant 1 connection 4 single 2 arrangement 3 procuring 1 conveyance 1 receiving 1 authorizing 1 extended 1 discriminatory 2 scope 1 prohibits 1 conditioned 1 business 1 distributing 1 payment 1 activity 1 primarily 1 compilations 1 contain 1 entered 1 was 1 28 1 march 1 construed 1 excluding 1 implied 4 defenses 1 12 1 imposed 2 court 1 contradict 1 excuse 1 simultaneously 1 pertinent 1 agree 1 obligate 1 collect 1 whom 1 refrain 1 entirely 1 13 2 affero 3 link 1 combine 1 concerning 1 combination 1 14 1 revised 2 spirit 1 present 1 differ 1 detail 1 address 1 concerns 1 distinguishing 1 number 2 specifies 2 numbered 2 later 5 published 3 specify 1 choose 2 ever 1 proxy 2 decide 1 result 1 choosing 1 disclaimer 3 writing 2 expressed 1 limited 2 merchantability 2 fitness 2 risk 1 quality 1 performance 1 prove 1 defective 1 assume 1 necessary 2 servicing 1 repair 1 correction 1 limitation 2 event 1 agreed 1 damages 3 incidental 1 consequential 1 arising 1 out 1 inability 1 loss 1 rendered 1 inaccurate 1 losses 1 sustained 1 failure 1 operate 1 even 2 advised 1 possibility 1 17 1 interpretation 1 local 2 effect 1 according 1 reviewing 1 courts 1 closely 1 approximates 1 absolute 1 waiver 1 civil 1 assumption 1 accompanies 1 return 1 end 1 develop 1 greatest 1 possible 1 best 1 achieve 1 redistribute 3 attach 2 safest 1 start 1 file 2 state 1 exclusion 1 line 2 pointer 1 full 1 found 1 name 3 brief 1 idea 1 year 2 distributed 1 hope 1 useful 2 see 3 details 3 www 3 contact 1 electronic 1 paper 1 mail 1 terminal 1 short 1 starts 1 absolutely 1 type 2 w 2 welcome 1 hypothetical 1 course 1 might 1 gui 1 about 1 box 1 employer 1 programmer 1 school 1 sign 1 incorporating 1 subroutine 1 consider 1 linking 1 applications 1 lesser 1 instead 1 please 1 read 1 why 1 lgpl 1 html 1"),
    ("LGPL-2.1", "gnu 17 lesser 15 general 27 public 29 license 76 version 25 2 13 1 11 february 1 1999 2 copyright 14 c 5 1991 1 free 36 software 35 foundation 9 inc 3 51 2 franklin 2 street 2 fifth 2 floor 2 boston 2 ma 2 02110 2 1301 2 usa 2 everyone 2 is 79 permitted 5 to 140 copy 30 and 91 distribute 23 verbatim 3 copies 9 of 160 this 67 document 1 but 8 changing 1 it 50 not 41 allowed 2 the 349 first 2 released 1 gpl 1 also 10 counts 1 as 30 successor 1 library 140 hence 1 number 5 preamble 1 licenses 4 for 53 most 3 are 18 designed 3 take 1 away 1 your 15 freedom 9 share 2 change 7 by 39 contrast 1 intended 4 guarantee 1 make 10 sure 4 all 16 its 10 users 3 applies 5 some 3 specially 1 designated 4 packages 1 typically 1 libraries 9 other 26 authors 1 who 7 decide 2 use 27 you 88 can 13 too 2 we 17 suggest 1 think 1 carefully 1 about 1 whether 8 or 80 ordinary 11 better 1 strategy 1 in 45 any 39 particular 5 case 4 based 16 on 30 explanations 1 below 2 when 8 speak 1 referring 1 price 1 our 3 that 79 have 10 charge 5 service 1 if 40 wish 5 receive 4 source 15 code 23 get 3 want 3 pieces 1 new 6 programs 9 informed 1 do 11 these 19 things 3 protect 4 rights 11 need 3 restrictions 4 forbid 1 distributors 1 deny 1 ask 2 surrender 1 translate 1 certain 6 responsibilities 1 modify 10 example 5 gratis 1 a 123 fee 3 must 23 give 5 recipients 4 gave 1 they 8 link 5 with 42 provide 2 complete 6 object 10 files 5 so 15 relink 2 them 6 after 1 making 3 changes 3 recompiling 1 show 1 terms 26 know 2 their 2 two 4 step 1 method 1 offer 4 which 11 gives 1 legal 1 permission 5 each 9 distributor 1 very 1 clear 2 there 5 no 7 warranty 10 modified 11 someone 1 else 2 passed 2 should 5 what 5 original 5 author 4 s 7 reputation 1 will 10 be 29 affected 1 problems 2 might 1 introduced 1 others 1 finally 1 patents 3 pose 1 constant 1 threat 1 existence 1 program 12 company 1 cannot 4 effectively 2 restrict 1 obtaining 1 restrictive 1 from 17 patent 5 holder 5 therefore 6 insist 1 obtained 1 consistent 2 full 3 specified 3 including 5 covered 6 quite 1 different 1 order 3 permit 3 linking 5 those 5 into 5 non 6 linked 7 statically 1 using 3 shared 2 combination 2 legally 2 speaking 1 combined 5 work 58 derivative 12 permits 2 such 17 only 6 entire 3 fits 1 criteria 2 more 5 lax 1 call 1 because 3 does 10 less 4 user 10 than 7 provides 2 developers 1 an 12 advantage 1 over 1 competing 1 disadvantages 1 reason 2 many 3 however 5 advantages 1 special 4 circumstances 2 rare 1 occasions 1 may 21 encourage 1 widest 1 possible 2 becomes 1 de 1 facto 1 standard 1 achieve 1 frequent 1 same 7 job 1 widely 1 used 6 little 1 gain 1 limiting 1 cases 1 enables 2 greater 1 people 3 large 1 body 2 whole 7 operating 4 system 9 well 3 variant 1 linux 1 although 1 protective 1 ensure 2 has 7 wherewithal 1 run 3 precise 1 conditions 11 copying 5 distribution 17 modification 5 follow 1 pay 1 close 1 attention 1 difference 1 between 1 uses 13 former 1 contains 5 derived 2 whereas 1 latter 1 0 1 agreement 2 notice 6 placed 1 authorized 1 party 3 saying 1 distributed 9 under 24 called 2 licensee 2 addressed 1 means 5 collection 1 functions 4 data 7 prepared 1 conveniently 1 application 8 form 6 executables 4 refers 2 been 2 either 7 law 5 say 1 containing 5 portion 5 modifications 4 translated 1 straightforwardly 1 another 2 language 1 hereinafter 1 translation 1 included 1 without 5 limitation 3 term 1 preferred 1 modules 1 plus 3 associated 1 interface 2 definition 1 scripts 1 control 2 compilation 1 installation 1 activities 1 outside 2 scope 3 act 2 running 1 restricted 2 output 1 contents 2 constitute 1 independent 3 tool 1 writing 3 true 3 depends 1 medium 3 provided 7 conspicuously 1 appropriately 1 publish 2 appropriate 1 disclaimer 2 keep 1 intact 1 notices 6 refer 3 absence 1 along 3 physical 1 transferring 1 at 7 option 4 protection 1 exchange 1 thus 4 forming 1 section 13 above 9 meet 1 itself 4 b 3 cause 2 carry 1 prominent 3 stating 1 changed 1 date 1 licensed 2 third 4 parties 7 d 2 facility 4 function 6 table 3 supplied 2 argument 1 invoked 1 then 8 good 1 faith 1 effort 1 event 2 supply 3 still 3 operates 1 performs 1 whatever 2 part 6 purpose 6 remains 1 meaningful 1 compute 2 square 3 roots 2 entirely 3 defined 2 subsection 2 2d 1 requires 1 optional 1 root 1 requirements 1 apply 7 identifiable 1 sections 8 reasonably 1 considered 1 separate 3 works 6 themselves 1 whose 2 permissions 1 licensees 1 extend 1 every 1 regardless 2 wrote 1 intent 2 claim 1 contest 2 written 4 rather 3 exercise 2 right 2 collective 1 addition 1 mere 1 aggregation 1 volume 1 storage 1 bring 1 3 1 opt 1 instead 3 given 3 alter 2 newer 1 appeared 1 specify 2 once 1 made 6 irreversible 1 subsequent 1 useful 2 4 1 executable 11 accompany 5 corresponding 2 machine 3 readable 3 customarily 1 interchange 1 offering 3 access 4 place 5 equivalent 2 satisfies 1 requirement 2 even 4 though 2 compelled 1 5 1 being 2 compiled 1 isolation 1 falls 1 creates 1 portions 3 6 5 states 1 material 1 header 1 file 5 especially 1 significant 1 threshold 1 precisely 1 numerical 1 parameters 1 structure 1 layouts 1 accessors 1 small 2 macros 1 inline 1 ten 1 lines 1 length 1 unrestricted 1 fall 2 otherwise 5 directly 2 exception 2 combine 1 produce 2 choice 2 customer 1 own 1 reverse 1 engineering 1 debugging 1 during 1 execution 1 displays 1 include 3 among 2 reference 1 directing 1 one 4 were 1 understood 1 definitions 2 necessarily 1 able 1 recompile 1 suitable 2 mechanism 2 time 4 already 3 present 2 computer 1 operate 2 properly 1 installs 1 long 2 compatible 1 was 1 valid 1 least 2 three 1 years 1 materials 4 6a 1 cost 2 performing 1 e 1 verify 1 received 3 sent 1 required 3 utility 1 needed 1 reproducing 1 anything 1 normally 2 binary 1 major 1 components 1 compiler 1 kernel 1 runs 1 unless 2 component 1 accompanies 1 happen 1 contradicts 1 proprietary 1 contradiction 1 both 2 together 2 7 1 facilities 4 side 2 single 1 uncombined 2 fact 1 explaining 1 where 2 find 1 accompanying 1 8 1 sublicense 2 except 2 expressly 1 attempt 1 void 1 automatically 2 terminate 1 terminated 1 remain 1 compliance 2 9 1 accept 2 since 1 signed 1 nothing 1 grants 1 actions 1 prohibited 1 modifying 2 distributing 2 indicate 1 acceptance 1 10 1 redistribute 4 recipient 1 receives 1 licensor 1 subject 1 impose 2 further 1 granted 1 herein 1 responsible 1 enforcing 1 11 1 consequence 3 court 2 judgment 1 allegation 1 infringement 1 limited 3 issues 1 imposed 1 contradict 1 excuse 1 satisfy 2 simultaneously 1 obligations 2 pertinent 1 would 2 royalty 1 redistribution 2 indirectly 1 through 3 way 1 could 1 refrain 1 held 1 invalid 1 unenforceable 1 circumstance 1 balance 1 induce 1 infringe 1 property 1 claims 2 validity 1 sole 1 protecting 1 integrity 1 implemented 1 practices 1 generous 1 contributions 1 wide 1 range 1 reliance 1 up 1 donor 1 he 1 she 1 willing 1 thoroughly 1 believed 1 rest 1 12 1 countries 3 copyrighted 2 interfaces 1 places 1 add 2 explicit 1 geographical 1 excluding 1 excluded 1 incorporates 1 13 1 revised 1 versions 2 similar 1 spirit 1 differ 1 detail 1 address 1 concerns 1 distinguishing 1 specifies 1 later 3 following 2 published 3 choose 1 ever 1 14 1 incorporate 1 parts 1 incompatible 1 write 3 sometimes 1 exceptions 1 decision 1 guided 1 goals 1 preserving 1 status 1 derivatives 1 promoting 1 sharing 1 reuse 1 generally 1 15 1 extent 1 applicable 2 stated 1 holders 1 kind 1 expressed 1 implied 3 warranties 1 merchantability 2 fitness 2 risk 1 quality 1 performance 1 prove 1 defective 1 assume 1 necessary 2 servicing 1 repair 1 correction 1 16 1 agreed 1 liable 1 damages 3 incidental 1 consequential 1 arising 1 out 1 inability 1 loss 1 rendered 1 inaccurate 1 losses 1 sustained 1 failure 1 advised 1 possibility 1 end 1 how 2 develop 1 greatest 1 recommend 1 permitting 1 alternatively 1 attach 2 safest 1 start 1 convey 1 exclusion 1 line 2 pointer 1 found 1 name 2 brief 1 idea 1 year 1 hope 1 see 1 details 1 information 1 contact 1 electronic 1 paper 1 mail 1 employer 1 programmer 1 school 1 sign 1 here 1 sample 1 names 1 yoyodyne 1 hereby 1 disclaims 1 interest 1 frob 1 tweaking 1 knobs 1 james 1 random 1 hacker 1 signature 1 ty 2 coon 2 april 1 1990 1 president 1 vice 1"),
    ("LGPL-3.0", "gnu 21 lesser 9 general 11 public 12 license 25 version 27 3 8 29 1 june 1 2007 2 copyright 3 c 2 free 4 software 4 foundation 4 inc 1 https 1 fsf 1 org 1 everyone 1 is 18 permitted 1 to 22 copy 10 and 30 distribute 1 verbatim 1 copies 2 of 60 this 15 document 4 but 5 changing 1 it 8 not 9 allowed 1 the 114 incorporates 1 terms 8 conditions 2 supplemented 1 by 17 additional 3 permissions 2 listed 1 below 2 0 2 definitions 1 as 8 used 3 herein 1 refers 4 gpl 10 library 34 a 44 covered 5 work 24 governed 1 other 4 than 2 an 9 application 14 or 14 combined 21 defined 2 any 8 that 26 makes 1 use 6 interface 3 provided 4 which 2 otherwise 2 based 5 on 7 defining 1 subclass 1 class 1 deemed 1 mode 1 using 1 produced 2 combining 1 linking 2 with 16 particular 1 was 1 made 1 also 2 called 1 linked 5 minimal 3 corresponding 9 source 8 for 15 means 2 excluding 2 code 11 portions 2 considered 1 in 13 isolation 1 are 6 object 6 including 1 data 4 utility 1 programs 1 needed 1 reproducing 1 from 4 system 2 libraries 2 1 2 exception 1 section 5 you 20 may 9 convey 6 under 10 sections 1 4 2 without 1 being 1 bound 1 2 1 conveying 3 modified 7 versions 5 if 10 modify 1 your 4 modifications 2 facility 4 function 2 be 3 supplied 1 uses 2 argument 1 passed 1 when 1 invoked 1 then 1 make 1 good 1 faith 1 effort 1 ensure 1 event 1 does 2 supply 1 still 1 operates 1 performs 1 whatever 1 part 3 its 3 purpose 1 remains 1 meaningful 1 b 5 none 1 applicable 1 incorporating 1 material 3 header 2 files 1 form 3 incorporate 1 file 1 such 6 choice 3 incorporated 1 limited 1 numerical 1 parameters 1 structure 1 layouts 1 accessors 1 small 1 macros 1 inline 1 functions 1 templates 1 ten 1 fewer 1 lines 1 length 1 do 5 both 2 following 5 give 3 prominent 3 notice 4 each 4 accompany 4 works 1 taken 1 together 2 effectively 1 restrict 1 modification 1 contained 1 reverse 1 engineering 1 debugging 1 displays 1 notices 2 during 1 execution 1 include 1 among 1 these 1 well 1 reference 1 directing 1 user 3 d 1 one 2 suitable 3 permit 1 recombine 1 relink 1 produce 1 manner 2 specified 2 6 4 shared 1 mechanism 2 at 1 run 1 time 3 already 1 present 2 s 2 computer 1 will 2 operate 1 properly 1 compatible 1 e 1 provide 3 installation 3 information 5 only 2 would 1 required 1 extent 1 necessary 1 install 1 execute 1 recombining 1 relinking 1 option 3 4d0 1 must 2 4d1 1 5 1 place 1 facilities 3 side 2 single 1 applications 1 same 2 uncombined 2 conveyed 1 explaining 1 where 1 find 1 accompanying 1 revised 2 publish 1 new 3 similar 1 spirit 1 differ 1 detail 1 address 1 problems 1 concerns 1 given 1 distinguishing 1 number 2 received 3 specifies 2 certain 1 numbered 1 later 2 applies 1 have 1 either 1 published 3 specify 1 choose 2 ever 1 proxy 2 can 1 decide 1 whether 1 future 1 shall 1 apply 1 statement 1 acceptance 1 permanent 1 authorization 1"),
    ("MPL-2.0", "mozilla 5 public 6 license 69 version 17 2 27 0 6 1 30 definitions 1 contributor 35 means 18 each 6 individual 2 or 67 legal 4 entity 6 that 26 creates 1 contributes 1 to 62 the 130 creation 2 of 115 owns 1 covered 36 software 39 combination 3 contributions 8 others 1 if 17 any 44 used 2 by 26 a 55 and 36 particular 6 s 8 contribution 5 3 22 4 7 source 20 code 21 form 29 which 5 initial 3 has 5 attached 3 notice 11 in 30 exhibit 5 executable 7 such 32 modifications 6 case 1 including 7 portions 1 thereof 1 5 9 incompatible 6 with 22 secondary 12 licenses 13 described 3 b 12 was 2 made 4 available 3 under 35 terms 20 earlier 1 but 2 not 17 also 3 6 3 work 11 other 8 than 5 7 3 larger 6 combines 1 material 1 separate 1 file 7 files 1 is 23 8 2 this 49 document 1 9 2 licensable 3 having 2 right 2 grant 6 maximum 2 extent 6 possible 3 whether 3 at 4 time 2 subsequently 1 all 7 rights 14 conveyed 2 10 8 following 1 results 1 from 9 an 7 addition 1 deletion 1 modification 1 contents 1 new 5 contains 1 11 1 patent 10 claims 8 claim 2 without 5 limitation 8 method 1 process 1 apparatus 1 would 2 be 18 infringed 2 for 22 making 2 using 1 selling 1 offering 1 sale 2 import 2 transfer 2 either 6 its 14 12 1 gnu 3 general 3 lesser 1 affero 1 later 1 versions 6 those 1 13 1 preferred 1 14 1 you 50 your 9 exercising 1 entities 1 includes 1 controls 1 controlled 1 common 1 control 2 purposes 1 definition 1 power 1 direct 2 indirect 2 cause 1 direction 1 management 1 contract 3 otherwise 4 ownership 3 more 4 fifty 1 percent 1 50 1 outstanding 1 shares 1 beneficial 1 grants 6 conditions 3 hereby 2 world 1 wide 1 royalty 1 free 2 non 5 exclusive 1 intellectual 1 property 1 trademark 1 use 6 reproduce 1 make 4 modify 2 display 1 perform 1 distribute 9 exploit 1 on 8 unmodified 1 basis 4 as 12 part 3 sell 1 offer 3 have 6 effective 2 date 2 granted 9 section 11 respect 3 become 3 first 2 distributes 2 limitations 4 scope 1 are 5 only 4 no 8 additional 5 will 3 implied 2 distribution 6 licensing 1 notwithstanding 1 above 3 removed 1 infringements 1 caused 1 i 1 third 1 party 4 ii 1 except 7 c 1 absence 1 does 2 trademarks 1 service 1 marks 1 logos 1 may 16 necessary 3 comply 6 requirements 2 subsequent 3 makes 1 result 2 choice 2 see 1 permitted 2 representation 1 represents 2 believes 1 original 1 it 7 sufficient 1 fair 3 intended 1 limit 2 applicable 2 copyright 3 doctrines 1 dealing 1 equivalents 1 sections 2 responsibilities 1 create 5 contribute 1 must 9 inform 2 recipients 5 governed 4 how 2 they 3 can 3 obtain 3 copy 3 attempt 2 alter 4 restrict 1 then 5 reasonable 3 timely 1 manner 1 charge 2 cost 2 recipient 4 sublicense 1 different 1 provided 4 one 4 permits 1 additionally 1 so 3 their 1 option 1 further 1 notices 6 remove 2 substance 1 disclaimers 2 warranty 8 liability 9 contained 1 within 1 required 1 remedy 1 known 1 factual 1 inaccuracies 1 application 1 choose 2 fee 1 support 3 indemnity 3 obligations 1 however 2 do 2 own 1 behalf 2 absolutely 1 clear 1 obligation 1 offered 1 alone 1 agree 1 indemnify 1 every 1 incurred 1 include 2 specific 1 jurisdiction 3 inability 1 due 2 statute 3 regulation 4 impossible 1 some 4 judicial 1 order 1 describe 1 affect 1 description 2 placed 1 text 1 included 1 distributions 1 prohibited 1 sufficiently 1 detailed 1 ordinary 1 skill 1 able 1 understand 1 termination 4 terminate 2 automatically 1 fail 1 compliant 2 reinstated 2 provisionally 1 unless 1 until 1 explicitly 1 finally 1 terminates 1 ongoing 2 fails 1 notify 1 compliance 4 prior 3 60 1 days 2 after 2 come 1 back 1 into 1 moreover 1 notifies 1 received 2 30 1 receipt 1 initiate 1 litigation 4 against 3 asserting 1 infringement 1 excluding 2 declaratory 1 judgment 1 actions 1 counter 2 cross 2 alleging 1 directly 1 indirectly 1 infringes 1 contributors 1 shall 10 event 1 end 1 user 1 agreements 1 distributors 2 resellers 1 been 2 validly 1 survive 1 disclaimer 3 kind 1 expressed 1 statutory 1 warranties 1 defects 1 merchantable 1 fit 1 purpose 1 infringing 1 entire 1 risk 1 quality 1 performance 1 should 1 prove 1 defective 1 assume 1 servicing 1 repair 1 correction 1 constitutes 1 essential 1 authorized 1 circumstances 1 theory 1 tort 1 negligence 2 anyone 1 who 1 liable 1 special 1 incidental 2 consequential 2 damages 5 character 1 lost 1 profits 1 loss 1 goodwill 1 stoppage 1 computer 1 failure 1 malfunction 1 commercial 1 losses 1 even 1 informed 1 possibility 1 apply 2 death 1 personal 1 injury 1 resulting 1 law 3 prohibits 1 jurisdictions 1 allow 1 exclusion 2 relating 1 brought 1 courts 1 where 2 defendant 1 maintains 1 principal 1 place 1 business 1 laws 1 reference 1 conflict 1 provisions 1 nothing 1 prevent 1 ability 1 bring 1 miscellaneous 1 complete 1 agreement 1 concerning 1 subject 2 matter 1 hereof 1 provision 2 held 1 unenforceable 1 reformed 1 enforceable 1 provides 1 language 1 construed 1 drafter 1 construe 1 foundation 1 steward 4 publish 1 given 1 distinguishing 1 number 1 effect 1 originally 1 published 1 modified 3 want 1 rename 1 references 1 name 1 note 1 differs 1 distributing 1 v 2 mpl 2 distributed 1 http 1 org 1 desirable 1 put 1 location 1 relevant 1 directory 1 likely 1 look 1 add 1 accurate 1 defined 1"),
    ("CC0-1.0", "creative 7 commons 8 legal 5 code 1 cc0 7 1 2 0 1 universal 1 corporation 1 is 6 not 10 a 18 law 8 firm 1 and 55 does 2 provide 1 services 1 distribution 2 of 50 this 7 document 5 create 1 an 5 attorney 1 client 1 relationship 1 provides 1 information 3 on 4 as 9 basis 1 makes 3 no 4 warranties 3 regarding 1 the 66 use 7 or 45 works 5 provided 4 hereunder 2 disclaims 3 liability 1 for 18 damages 1 resulting 1 from 1 statement 4 purpose 8 laws 1 most 1 jurisdictions 1 throughout 2 world 2 automatically 1 confer 1 exclusive 2 copyright 11 related 11 rights 22 defined 1 below 2 upon 2 creator 1 subsequent 1 owner 3 s 11 each 4 all 5 original 2 work 26 authorship 1 database 2 certain 1 owners 2 wish 1 to 29 permanently 2 relinquish 1 those 3 contributing 1 cultural 2 scientific 2 that 6 public 4 can 1 reliably 1 without 7 fear 1 later 1 claims 4 infringement 2 build 1 modify 1 incorporate 1 in 21 other 7 reuse 2 redistribute 1 freely 1 possible 1 any 24 form 1 whatsoever 3 purposes 5 including 9 limitation 5 commercial 3 these 2 may 3 contribute 1 promote 1 ideal 1 free 2 culture 1 further 2 production 1 gain 1 reputation 1 greater 1 their 1 part 3 through 1 efforts 1 others 1 motivations 1 expectation 1 additional 1 consideration 1 compensation 1 person 4 associating 1 with 4 affirmer 17 extent 5 he 2 she 2 voluntarily 1 elects 1 apply 2 publicly 1 distribute 2 under 7 its 1 terms 1 knowledge 1 his 2 her 2 meaning 1 intended 1 effect 1 made 1 available 1 be 6 protected 1 by 10 neighboring 1 include 1 but 2 are 2 limited 1 following 1 i 4 right 1 reproduce 1 adapt 1 perform 1 display 1 communicate 1 translate 1 ii 4 moral 1 retained 1 author 1 performer 1 iii 3 publicity 1 privacy 1 pertaining 1 image 1 likeness 1 depicted 1 iv 3 protecting 2 against 1 unfair 1 competition 1 regards 1 subject 2 limitations 2 paragraph 1 4 2 v 1 extraction 1 dissemination 1 data 1 vi 1 such 5 arising 1 directive 2 96 1 9 1 ec 1 european 1 parliament 1 council 1 11 1 march 1 1996 1 protection 1 databases 1 national 2 implementation 1 thereof 3 amended 1 successor 1 version 1 vii 1 similar 1 equivalent 1 corresponding 1 based 1 applicable 7 treaty 3 implementations 1 2 1 waiver 7 greatest 2 permitted 2 contravention 1 hereby 3 overtly 1 fully 2 irrevocably 1 unconditionally 1 waives 1 abandons 1 surrenders 1 associated 2 causes 3 action 4 whether 2 now 1 known 1 unknown 1 existing 1 well 1 future 5 territories 2 worldwide 2 maximum 3 duration 2 time 2 extensions 2 current 2 medium 2 number 2 copies 2 advertising 2 promotional 2 benefit 1 member 1 at 1 large 1 detriment 1 heirs 1 successors 1 intending 1 shall 4 revocation 1 rescission 1 cancellation 1 termination 1 equitable 1 disrupt 1 quiet 1 enjoyment 1 contemplated 1 express 4 3 1 license 6 fallback 1 should 2 reason 2 judged 3 legally 2 invalid 2 ineffective 2 then 1 preserved 1 taking 1 into 1 account 1 addition 1 so 1 grants 1 affected 2 royalty 1 non 4 transferable 1 sublicensable 1 irrevocable 1 unconditional 1 exercise 2 deemed 1 effective 1 date 1 was 1 applied 1 partial 1 invalidity 1 ineffectiveness 1 invalidate 1 remainder 1 case 2 affirms 1 will 1 remaining 1 assert 1 respect 2 either 1 contrary 1 disclaimers 1 trademark 1 patent 1 held 1 waived 1 abandoned 1 surrendered 1 licensed 1 otherwise 2 b 1 offers 1 representations 1 kind 1 concerning 1 implied 1 statutory 1 title 1 merchantability 1 fitness 1 particular 1 absence 2 latent 1 defects 1 accuracy 1 present 1 errors 1 discoverable 1 permissible 1 c 1 responsibility 2 clearing 1 persons 1 obtaining 1 necessary 1 consents 1 permissions 1 required 1 d 1 understands 1 acknowledges 1 party 1 has 1 duty 1 obligation 1"),
)
