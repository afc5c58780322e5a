"""Bundled grammars of the predictive parsers (see ``lltable``).

They recognise, they do not build trees: operators of one kind share a level, whatever their precedence.
"""

PYTHON = r"""
file: (NEWLINE | stmt)* END
stmt: small (';' small)* [';'] NEWLINE | compound
small: expr_stmt | 'del' targets | 'pass' | 'break' | 'continue' | 'return' [star_list] | 'raise' [test ['from' test]]
    | ('global' | 'nonlocal') NAME (',' NAME)* | 'assert' test [',' test] | 'import' dotted_as (',' dotted_as)*
    | 'from' (('.' | '...')+ from_rest | dotted 'import' imports) | TYPE NAME [type_params] '=' test
from_rest: dotted 'import' imports | 'import' imports
imports: '*' | '(' import_as (',' import_as)* [','] ')' | import_as (',' import_as)*
import_as: NAME ['as' NAME]
dotted_as: dotted ['as' NAME]
dotted: NAME ('.' NAME)*
expr_stmt: (star_list | yield_expr) [':' test ['=' (star_list | yield_expr)] | AUG (star_list | yield_expr) | ('=' (star_list | yield_expr))+]
star_list: star_item (',' star_item)* [',']
star_item: '*' arith | named
targets: target (',' target)* [',']
target: '*' arith | arith
yield_expr: 'yield' ['from' test | star_list]
named: test [':=' test]
test: 'lambda' [lambda_params] ':' test | logic ['if' logic 'else' test]
logic: negated (('and' | 'or') negated)*
negated: 'not' negated | arith (('<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' ['not']) arith)*
arith: unary (OP unary | '/' unary | '*' unary | '**' unary | SIGN unary)*
unary: (SIGN | '~')* power
power: ['await'] atom trailer*
trailer: '(' [args] ')' | '[' subs ']' | '.' NAME
atom: NAME | NUMBER | (STRING | fstring)+ | '...' | 'None' | 'True' | 'False' | '(' [group] ')' | '[' [items] ']' | '{' [entries] '}'
group: yield_expr | items
items: star_item (comp_for | (',' star_item)* [','])
entries: entry (comp_for | (',' entry)* [','])
entry: '**' arith | '*' arith | named [':' test]
args: arg (',' arg)* [',']
arg: '*' test | '**' test | named ['=' test | comp_for]
subs: sub (',' sub)* [',']
sub: '*' arith | named [':' [test] [':' [test]]] | ':' [test] [':' [test]]
comp_for: ['async'] 'for' targets 'in' logic (['async'] 'for' targets 'in' logic | 'if' logic)*
fstring: FSTART (FMIDDLE | fhole)* FEND
fhole: '{' (yield_expr | star_list) ['='] ['!' NAME] [':' (FMIDDLE | fhole)*] '}'
lambda_params: lambda_param (',' lambda_param)* [',']
lambda_param: '*' [NAME] | '**' NAME | '/' | NAME ['=' test]
params: param (',' param)* [',']
param: '*' [NAME [':' star_item]] | '**' NAME [':' test] | '/' | NAME [':' test] ['=' test]
type_params: '[' type_param (',' type_param)* [','] ']'
type_param: ('*' | '**') NAME ['=' test] | NAME [':' test] ['=' test]
compound: 'if' named ':' block ('elif' named ':' block)* ['else' ':' block] | 'while' named ':' block ['else' ':' block]
    | for_stmt | with_stmt | try_stmt | func | klass | '@' named NEWLINE ('@' named NEWLINE)* (func | klass | 'async' func)
    | 'async' (func | for_stmt | with_stmt) | MATCH star_list ':' NEWLINE INDENT case+ DEDENT
case: CASE patterns [GUARD named] ':' block
patterns: star_pattern (',' star_pattern)* [',']
star_pattern: '*' NAME | pattern
pattern: closed_pattern (BAR closed_pattern)* [AS NAME]
closed_pattern: [SIGN] NUMBER [SIGN NUMBER] | (STRING | fstring)+ | 'None' | 'True' | 'False' | dotted ['(' [class_pattern (',' class_pattern)* [',']] ')']
    | '(' [patterns] ')' | '[' [patterns] ']' | '{' [map_pattern (',' map_pattern)* [',']] '}'
class_pattern: pattern ['=' pattern]
map_pattern: '**' NAME | closed_pattern ':' pattern
for_stmt: 'for' targets 'in' star_list ':' block ['else' ':' block]
with_stmt: 'with' (with_item (',' with_item)* | WOPEN with_item (',' with_item)* [','] WCLOSE) ':' block
with_item: test ['as' target]
try_stmt: 'try' ':' block ((except+ | except_group+) ['else' ':' block] ['finally' ':' block] | 'finally' ':' block)
except: 'except' [test ['as' NAME]] ':' block
except_group: EXCEPTS '*' test ['as' NAME] ':' block
func: 'def' NAME [type_params] '(' [params] ')' ['->' test] ':' block
klass: 'class' NAME [type_params] ['(' [args] ')'] ':' block
block: small (';' small)* [';'] NEWLINE | NEWLINE INDENT stmt+ DEDENT
"""

PROTO = r"""
file: item* END
item: 'syntax' '=' STRING+ ';' | 'edition' '=' STRING+ ';' | 'import' ['weak' | 'public'] STRING+ ';' | 'package' name ';' | option | message | enum | extend | service | ';'
name: ident ('.' ident)*
typename: ['.'] name
ident: NAME | 'syntax' | 'edition' | 'import' | 'weak' | 'public' | 'package' | 'option' | 'message' | 'enum' | 'extend' | 'service' | 'rpc' | 'returns' | 'stream' | 'oneof' | 'map' | 'repeated' | 'optional' | 'reserved' | 'extensions' | 'to' | 'max' | 'required' | 'group'
option: 'option' option_name '=' constant ';'
option_name: option_part ('.' option_part)*
option_part: ident | '(' typename ')'
constant: ['-' | '+'] (INT | FLOAT | name) | STRING+ | '{' aggregate '}' | '[' [constant (',' constant)*] ']'
aggregate: (agg_name (':' constant | '{' aggregate '}') [',' | ';'])*
agg_name: ident | '[' typename ['/' typename] ']'
options: '[' option_name '=' constant (',' option_name '=' constant)* ']'
message: 'message' ident body
body: '{' member* '}'
member: ';' | message | enum | extend | option | oneof | mapfield | reserved | extensions | label field | 'group' ident | field
label: 'repeated' | 'optional'
field: fieldtype ident '=' INT [options] (';' | body)
fieldtype: ['.'] fieldident ('.' ident)*
fieldident: NAME | 'syntax' | 'edition' | 'import' | 'weak' | 'public' | 'package' | 'service' | 'rpc' | 'returns' | 'stream' | 'to' | 'max'
mapfield: 'map' '<' typename ',' typename '>' ident '=' INT [options] ';'
oneof: 'oneof' ident '{' (option | field | ';')* '}'
reserved: 'reserved' (range (',' range)* | STRING (',' STRING)* | ident (',' ident)*) ';'
extensions: 'extensions' range (',' range)* [options] ';'
range: ['-'] INT ['to' (['-'] INT | 'max')]
enum: 'enum' ident '{' enum_member* '}'
enum_member: option | reserved | ';' | enum_value
enum_value: enum_ident '=' ['-'] INT [options] ';'
enum_ident: NAME | 'syntax' | 'edition' | 'import' | 'weak' | 'public' | 'package' | 'message' | 'enum' | 'extend' | 'service' | 'rpc' | 'returns' | 'stream' | 'oneof' | 'map' | 'repeated' | 'optional' | 'extensions' | 'to' | 'max' | 'required' | 'group'
extend: 'extend' typename '{' (label field | field | ';')* '}'
service: 'service' ident '{' (option | rpc | ';')* '}'
rpc: 'rpc' ident '(' ['stream'] rpctype ')' 'returns' '(' ['stream'] rpctype ')' (';' | '{' (option | ';')* '}')
rpctype: ['.'] NAME ('.' ident)*
"""

CPP = r"""
file: decl* END
decl: ';' | namespace | linkage | template | using | klass | enum | assertion | access | 'typedef' decl | 'friend' decl | 'concept' ID ASSIGN expr ';' | simple_decl
access: ('public' | 'private' | 'protected') ID* ':'
namespace: 'namespace' (ID | '::')* ('{' decl* '}' | ASSIGN qid ';')
linkage: 'extern' (STR ('{' decl* '}' | decl) | template | simple_decl)
template: 'template' [TLT [soup_list] TGT] decl
using: 'using' ['namespace' | 'enum'] soup [ASSIGN soup] (',' soup)* ';'
assertion: 'static_assert' '(' expr (',' expr)* ')' ';'
klass: ('class' | 'struct' | 'union') (qid | SPEC)* ([':' base (',' base)*] '{' decl* '}' [words [klass_tail]] ';' | klass_rest)
base: (SPEC | 'public' | 'private' | 'protected' | qid | '...')+
klass_rest: [PTR words] [klass_tail] (';' | body)
klass_tail: postfix+ qualifier* [ASSIGN assigned] more* | ASSIGN init more* | more+
enum: 'enum' ['class' | 'struct'] (qid | SPEC)* ([':' (SPEC | qid)+] '{' [enumerator (',' [enumerator])*] '}' [words [klass_tail]] ';' | klass_rest)
enumerator: ID [ASSIGN expr]
simple_decl: words ['~' qid] rest | '~' qid rest
words: (SPEC | qid | PTR)+
rest: core [':' init_list] (';' | body)
core: postfix* qualifier* [core_end]
core_end: ASSIGN assigned more* | OP expr2 more* | SIGN expr2 more* | PTR expr2 more* | '?' init ':' expr more* | more+
assigned: init | 'default' | 'delete'
more: ',' unary [ASSIGN init]
body: ['try'] block ('catch' '(' (soup_item | '...') ')' block)*
init_list: expr ['...'] (',' expr ['...'])*
qualifier: SPEC ['(' [soup_list] ')'] | 'throw' '(' [soup_list] ')' | 'requires' expr
init: expr | braced
braced: '{' [braced_item (',' [braced_item])*] '}'
braced_post: BRACED [braced_item (',' [braced_item])*] '}'
braced_item: '.' ID (ASSIGN init | braced) | init ['...']
postfix: '(' [soup_list] ')' | access_tail
call: '(' [args] ')' | access_tail
access_tail: function_type | '[' [init (',' init)*] ']' | '.' member | '->' member | '++' | '--' | braced_post
function_type: FPTR PTR+ SPEC* ')' '(' [soup_list] ')'
args: arg (',' arg)*
arg: init ['...']
member: ['template'] ['~' | PTR] (qid | SPEC)
soup_list: soup_item (',' soup_item)*
soup_item: soup [ASSIGN init] | braced
soup: soup_first soup_rest*
soup_first: (SIGN | '!' | '~')* soup_word
soup_rest: (OP | '?') soup_first | ':' (soup_first | braced) | soup_first
soup_word: 'class' | 'struct' | 'union' | 'enum' | 'template' [TLT [soup_list] TGT] | SPEC | PTR | qid | NUM | STR | CHR | '(' [soup_list] ')' | function_type | LAMBDA lambda | '[' [expr (',' expr)*] ']' | '.' member | '->' member
    | '++' | '--' | 'new' | 'delete' | 'throw' | 'sizeof' | 'this' | 'co_await' | braced_post | '...'
expr: expr2 [ASSIGN init]
expr2: unary ((OP | SIGN) unary | PTR [unary] | SPEC)* ['?' init ':' expr]
unary: (PTR | SIGN | '!' | '~' | '++' | '--' | 'sizeof' ['...'] | 'co_await')* operand
operand: 'throw' [expr] | 'new' ['(' args ')'] (SPEC | qid | PTR)* call* | 'delete' ['[' ']'] unary | primary call*
primary: SPEC+ [literal] | qid | NUM | strings | CHR | 'this' | '...' | ('class' | 'struct' | 'union' | 'enum') qid | '(' args ')' [literal | ('!' | '~') unary] | LAMBDA lambda | 'requires' ['(' [soup_list] ')'] block
literal: qid | NUM | strings | CHR | 'this' | '(' [args] ')'
strings: STR (STR | qid)*
qid: ['::'] qid_part ('::' ['template'] ['~' | PTR] qid_part)*
qid_part: ID [TLT [soup_list] TGT]
lambda: [capture (',' capture)*] ']' [TLT [soup_list] TGT] ['(' [soup_list] ')'] qualifier* block
capture: ASSIGN | soup_item
block: '{' stmt* '}'
stmt: block | ';' | 'if' [SPEC] condition stmt ['else' stmt] | 'while' condition stmt | 'do' stmt 'while' condition ';'
    | 'for' '(' for_head ')' stmt | 'switch' condition stmt | 'case' expr2 ['...' expr2] ':' | 'default' ':' | ('return' | 'co_return' | 'co_yield') [init] ';'
    | 'break' ';' | 'continue' ';' | 'goto' ID ';' | 'try' block ('catch' '(' (soup_item | '...') ')' block)+ | using | klass | enum | template | namespace | assertion
    | 'typedef' simple_decl | 'extern' simple_decl | simple
condition: XP args ')' | '(' cond ')'
cond: soup [ASSIGN init] [';' [soup [ASSIGN init]]]
for_head: [for_part (',' for_part)*] [';' [expr] ';' [expr (',' expr)*]]
for_part: soup [ASSIGN init]
simple: qid (words [NUM | STR+ | CHR | 'this'] rest_stmt | rest_expr) | (SPEC | PTR) [words] [NUM | STR+ | CHR | 'this'] rest_stmt | other_expr rest_other
rest_expr: call* [core_end] (';' | body) | ':' stmt
rest_other: call* [core_end] ';'
other_expr: (SIGN | '!' | '~' | '++' | '--' | 'co_await' | 'sizeof') unary | NUM | STR+ | CHR | 'this' | LAMBDA lambda | '(' args ')' [literal | ('!' | '~') unary] | 'throw' [expr] | 'new' ['(' args ')'] words | 'delete' ['[' ']'] unary
rest_stmt: core ';' | ':' stmt
"""
