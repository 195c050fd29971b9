"""Public licence texts and notices that documents are held against.

Fixed values: the wording of the licences themselves. Each is (label, key, text); the key is the
phrase that tells this text from its relatives and has to be found whole.
"""

PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

TEMPLATES = [
    ("mit", "use copy modify merge publish distribute sublicense and or sell",
     """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
     this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "mit license", "Licensed under the MIT License."),
    ("isc", "use copy modify and or distribute this software",
     """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", "redistribution and use in source and binary forms",
     """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
     distribution."""),
    ("apache", "licensed under the apache license version 2 0",
     """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
     the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
     WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "under the terms of the gnu general public license",
     """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
     implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the gnu lesser general public license",
     """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
     Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
     later version."""),
    ("agpl", "under the terms of the gnu affero general public license",
     """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
     later version."""),
    ("mpl", "mozilla public license",
     """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "released into the public domain",
     """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
     compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
     commercial or non-commercial, and by any means."""),
    ("zlib", "altered source versions must be plainly marked",
     """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
     it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
     misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked
     as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from
     any source distribution."""),
    ("cc-by", "licensed under cc by 4 0", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "licensed under cc by sa 4 0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "licensed under cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "licensed under cc by nd 4 0", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "commons attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "attribution sharealike 4 0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "attribution noncommercial 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "waived all copyright and related or neighboring rights",
     """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""),
]
